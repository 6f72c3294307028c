"""Late interaction over cached token vectors: exact MaxSim rankings behind centroid bounds.

Every token vector of the cache is coded by the nearest of CODES centres, fitted on a bounded sample (SAMPLE
paragraphs lend a vector each). A paragraph keeps its distinct codes and, for each, how far its vectors lie from the
centre at most. For a question's vector q no vector of a paragraph is more similar than the best of q.c + |q| r over
its codes, so the sum of these over the question bounds the paragraph's score. A document's paragraphs are scored in
full in the order of that bound, and those whose bound is below the k-th score so far are left out: the ranking is
that of scoring all. A vector that a paragraph repeats changes no
maximum: a cache may hold each once. A document, its paragraphs and its questions, is the largest group there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import fitted, hashed_sample

SAMPLE, CODES, CHUNK, ROWS = 20_000, 64, 16, 2048
SLACK = 1e-6


def centres(cache: DataFrame, codes: int = CODES, sample: int = SAMPLE) -> np.ndarray:
    """Centres of the token vectors: a row each; no rows if the cache has no vectors."""
    at = F.pmod(F.xxhash64("doc_id", "pos"), F.size("vectors")).cast("int")
    lent = cache.where(F.size("vectors") > 0).select("doc_id", "pos", F.get("vectors", at).alias("v"))
    # rows are counted without their vectors; those that have none make the sample smaller
    found = hashed_sample(lent, ["doc_id", "pos"], sample, cache.count()).select("v").collect()
    rows = [r.v for r in found or lent.select("v").limit(sample).collect()]
    return fitted(np.array(rows, float), codes) if rows else np.zeros((0, 0))


def matrices(column: pa.Array) -> list[np.ndarray]:
    """A column of lists of vectors as a matrix a row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    inner = column.flatten()
    flat = np.asarray(inner.flatten(), float).reshape(len(inner), -1) if len(inner) else np.zeros((0, 0))
    return np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []


def coded(cache: DataFrame, centre: np.ndarray) -> DataFrame:
    """doc_id, pos, width, flat, codes and far: the paragraph's vectors, one after the other, its distinct codes and its farthest vector of each."""

    kind = dict(cache.dtypes)["vectors"].removeprefix("array<").removesuffix(">")
    number = pa.float32() if kind == "array<float>" else pa.float64()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                column = b.column("vectors")
                size, inner = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), column.flatten()
                n, width = len(size), 0
                lists = lambda count, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), values)  # noqa: B023, E731
                codes, far, flat, own, kept = np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(n, int), np.zeros(n, int)
                if len(inner):
                    m = np.asarray(inner.flatten(), float).reshape(len(inner), -1)
                    par, width = np.repeat(np.arange(n), size), m.shape[1]
                    near = (m @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)
                    distance = np.sqrt(((m - centre[near]) ** 2).sum(axis=1))
                    keys = par * len(centre) + near
                    order = np.argsort(keys, kind="stable")
                    begin = np.flatnonzero(np.diff(keys[order], prepend=-1))
                    codes, far, own = keys[order][begin] % len(centre), np.maximum.reduceat(distance[order], begin), np.bincount(keys[order][begin] // len(centre), minlength=n)
                    kept, flat = size, m.ravel()
                columns = [b.column("doc_id"), b.column("pos"), pa.array(np.full(n, width), pa.int32()), lists(kept * width, pa.array(flat, number)), lists(own, pa.array(codes, pa.int32())), lists(own, pa.array(far, pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "pos", "width", "flat", "codes", "far"])

    return cache.select("doc_id", "pos", "vectors").mapInArrow(work, f"doc_id long, pos long, width int, flat {kind}, codes array<int>, far array<double>")


def max_sim(q: np.ndarray, p: np.ndarray) -> float:
    return float((q @ p.T).max(axis=1).sum()) if len(q) and len(p) else 0.0


def best_paragraphs(q: np.ndarray, paragraphs: list[np.ndarray], pos: np.ndarray, bound: np.ndarray, k: int) -> tuple[list[tuple[float, int]], int]:
    """The k best (score, position) by falling score and position, and how many paragraphs were scored in full."""
    order, found, scored = np.argsort(-bound, kind="stable"), [], 0
    for i in order:
        if len(found) >= k and scored % CHUNK == 0:
            found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
            if bound[i] < found[-1][0] - SLACK:
                break
        found.append((round(max_sim(q, paragraphs[i]), 9), int(pos[i])))
        scored += 1
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k], scored


def ranked(questions: DataFrame, cache: DataFrame, k: int, codes: int = CODES) -> DataFrame:
    """query_id, pos, score, rank of each question's k best paragraphs of its document, and n_scored.

    questions: query_id, doc_id, vectors; cache: doc_id, pos, vectors. A side without vectors scores 0.
    A document's paragraphs and its questions meet in one row; a task's batch holds many of these.
    """
    centre = centres(cache, codes)

    def answers(asked: pa.StructArray, held: pa.StructArray) -> Iterator[tuple]:
        pos, width = held.field("pos").to_numpy(), int(max(held.field("width").to_numpy(), default=0))
        parts = lambda name: held.field(name).flatten().to_numpy(zero_copy_only=False)
        sizes = held.field("codes").value_lengths().to_numpy()
        upto = np.cumsum(held.field("flat").value_lengths().to_numpy())[:-1]
        paragraphs = [p.reshape(-1, max(width, 1)) for p in np.split(parts("flat").astype(float), upto)]
        own, far, begin = parts("codes"), parts("far"), (np.cumsum(sizes) - sizes)[sizes > 0]
        for name, q in zip(asked.field("query_id").to_pylist(), matrices(asked.field("vectors")), strict=True):
            bound = np.zeros(len(pos))
            if len(q) and len(own):
                bound[sizes > 0] = np.maximum.reduceat((q @ centre.T)[:, own] + np.linalg.norm(q, axis=1)[:, None] * far, begin, axis=1).sum(axis=0)
            best, scored = best_paragraphs(q, paragraphs, pos, bound, k)
            yield from ((name, p, s, rank, scored) for rank, (s, p) in enumerate(best, 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ("query_id", "pos", "score", "rank", "n_scored"), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        for b in batches:
            out = [row for i in range(b.num_rows) for row in answers(b.column("asked").slice(i, 1).flatten(), b.column("held").slice(i, 1).flatten())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)], names=list(names))

    asked = questions.groupBy("doc_id").agg(F.collect_list(F.struct("query_id", "vectors")).alias("asked"))
    held = coded(cache, centre).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "width", "flat", "codes", "far")).alias("held"))
    return asked.join(held, "doc_id").select("asked", "held").mapInArrow(work, "query_id long, pos long, score double, rank long, n_scored long")
