"""What the scores of a document's paragraphs are made of, counted from its words: term and bucket counts, paragraph frequencies.

A document is a row of a task's Arrow batch. The words of a batch are coded once, each distinct word is hashed once, and
every count is a sum over codes, block by block of documents of about BLOCK words. The formulas over these counts are
column expressions (``evidence``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: Buckets of the hashed vectors, and words of the documents that are counted together.
DIMENSIONS, BLOCK = 64, 1 << 19
#: Bytes of the texts that are multiplied together, and bytes that a paragraph counts as beside its text.
TEXTS, ROW = 4 << 20, 64
FIELDS = "tf array<array<int>>, dot array<long>, norm array<long>, asked_norm long, standing array<long>"


def starts(lists: pa.Array) -> np.ndarray:
    """Where each list's values begin in ``flatten``, and where the last ends."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def buckets(words: np.ndarray) -> np.ndarray:
    """Per word the two buckets that the first and the next four hex digits of its hash name."""
    digests = np.frombuffer(b"".join([md5(w.encode()).digest()[:4] for w in words]), ">u2").reshape(-1, 2)
    return (digests % DIMENSIONS).astype(np.int64)


def block_counts(ts: pa.Array, q: pa.Array, late: bool) -> dict[str, pa.Array]:
    """The fields of ``counted`` for some documents."""
    paragraphs, size = ts.flatten(), q.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    docs, upto, n, rows = starts(ts), starts(paragraphs), len(paragraphs), len(ts)
    every = pa.concat_arrays([paragraphs.flatten(), q.flatten()]).dictionary_encode()
    # the last row is what no place of a question asks for
    hashed = np.concatenate([buckets(every.dictionary.to_numpy(zero_copy_only=False)), [[-1, -1]]])
    code, asked = np.split(every.indices.to_numpy(zero_copy_only=False).astype(np.int64), [upto[-1]])
    par, doc = np.repeat(np.arange(n), np.diff(upto)), np.repeat(np.arange(rows), np.diff(docs))
    owner = np.repeat(np.arange(rows), size)
    wanted = np.full((rows, int(size.max(initial=0))), -1)
    wanted[owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)] = asked

    of, first, second = doc[par], hashed[code, 0], hashed[code, 1]
    number = lambda hit: np.bincount(par[hit], minlength=n)
    tf, dot, best = np.zeros((n, wanted.shape[1]), np.int64), np.zeros(n, np.int64), np.zeros(n)
    for j, w in enumerate(wanted.T):
        tf[:, j] = number(code == w[of])
        same = first == hashed[w, 0][of]
        dot += number(same)
        if late:
            other = second == hashed[w, 1][of]
            best += ((number(same | other) > 0).astype(float) + (number(same & other) > 0)) / 2.0
    filled = np.bincount(par * DIMENSIONS + first, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    own = np.bincount(owner * DIMENSIONS + hashed[asked, 0], minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS)

    # sorted by document, word and paragraph: each distinct word's paragraphs follow each other
    keys = np.sort((of * len(hashed) + code) * n + par)
    keys = keys[np.diff(keys, prepend=-1) > 0] // max(n, 1)
    begin = np.flatnonzero(np.diff(keys, prepend=-1))
    df = np.diff(begin, append=len(keys))
    standing = np.bincount(docs[keys[begin] // len(hashed)] + df - 1, minlength=n)

    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    wide = size[doc]
    tfs = lists(np.concatenate([[0], np.cumsum(wide)]), pa.array(tf[np.arange(tf.shape[1]) < wide[:, None]], pa.int32()))
    found = {"tf": tfs, "dot": pa.array(dot, pa.int64()), "norm": pa.array((filled**2).sum(axis=1), pa.int64()), "standing": pa.array(standing, pa.int64()), "late": pa.array(best, pa.float64())}
    found = {name: lists(docs, values) for name, values in found.items()}
    return found | {"asked_norm": pa.array((own**2).sum(axis=1), pa.int64())}


def counted(late: bool = False) -> Callable[[Column, Column], Column]:
    """ts (words of the paragraphs), q (the question's words) -> a struct.

    tf: per paragraph how often each of q occurs; dot and norm: product with the question's bucket counts, and squared
    length; asked_norm: the question's; standing: at i, how many distinct words stand in exactly i + 1 paragraphs; and,
    if asked for, late: the sum over q of the best share of common buckets.
    """
    kind = f"struct<{FIELDS}{', late array<double>' if late else ''}>"
    names = [f.split()[0] for f in FIELDS.split(", ")] + (["late"] if late else [])

    @arrow_udf(kind)
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ts, q in batches:
            docs, upto = starts(ts), starts(ts.flatten())
            load, at, done = upto[docs] + docs, 0, []
            while at < len(ts) or not done:
                end = max(at + 1, int(np.searchsorted(load, load[at] + BLOCK, "right")) - 1)
                found = block_counts(ts.slice(at, end - at), q.slice(at, end - at), late)
                done.append(pa.StructArray.from_arrays([found[name] for name in names], names))
                at = end
            yield pa.concat_arrays(done)

    return lambda ts, q: count(ts, q)


def block_products(texts: pa.Array, q: pa.Array) -> dict[str, pa.Array]:
    """The fields of ``products`` for some documents."""
    said, owner = pc.split_pattern(texts.flatten(), " "), np.repeat(np.arange(len(q)), np.diff(starts(q)))
    docs, upto, n, rows = starts(texts), starts(said), len(said), len(q)
    every = pa.concat_arrays([said.flatten(), q.flatten()]).dictionary_encode()
    hashed = buckets(every.dictionary.to_numpy(zero_copy_only=False))[:, 0]
    first, asked = np.split(hashed[every.indices.to_numpy(zero_copy_only=False)], [upto[-1]])
    par = np.repeat(np.arange(n), np.diff(upto))
    # a paragraph without words is one empty text, which no other paragraph holds
    empty = pc.equal(texts.flatten(), "").to_numpy(zero_copy_only=False)
    if empty.any():
        par, first = par[~empty[par]], first[~empty[par]]
    filled = np.bincount(par * DIMENSIONS + first, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    own = np.bincount(owner * DIMENSIONS + asked, minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS)
    dot = np.einsum("ij,ij->i", filled, np.repeat(own, np.diff(docs), axis=0))
    lists = lambda values: pa.ListArray.from_arrays(pa.array(docs, pa.int32()), pa.array(values, pa.int64()))
    return {"dot": lists(dot), "norm": lists(np.einsum("ij,ij->i", filled, filled)), "asked_norm": pa.array((own**2).sum(axis=1), pa.int64())}


def products() -> Callable[[Column, Column], Column]:
    """texts (of the paragraphs, one space between words), q (the question's words) -> dot, norm and asked_norm of ``counted``, and nothing that only other scores ask for."""

    @arrow_udf("struct<dot array<long>, norm array<long>, asked_norm long>")
    def multiply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, q in batches:
            docs, lengths = starts(texts), pc.binary_length(texts.flatten()).to_numpy(zero_copy_only=False)
            load, at, done = np.concatenate([[0], np.cumsum(lengths + ROW)])[docs], 0, []
            while at < len(texts) or not done:
                end = max(at + 1, int(np.searchsorted(load, load[at] + TEXTS, "right")) - 1)
                found = block_products(texts.slice(at, end - at), q.slice(at, end - at))
                done.append(pa.StructArray.from_arrays(list(found.values()), list(found)))
                at = end
            yield pa.concat_arrays(done)

    return lambda texts, q: multiply(texts, q)
