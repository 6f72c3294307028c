"""Packing by concatenate and cut.

Pass one tokenises every document, ends it with id 0 and notes how many tokens of its partition stand before
it. Pass two adds the prefix sum over the partitions' totals (one row a partition), which gives every token
its place in the corpus; sequence s holds the tokens from s * length on, and a document that crosses a border
has a piece on either side. Only the last sequence is padded.

The ids are those of the tokenizer file as the tokenizers library gives them. They are computed by tiktoken's
merge loop over the vocabulary of the same file, which gives the same ids (tests compare them) in a fifth of the
time; a file whose settings or merge order that loop does not reproduce is refused. A text is cut at the file's
added tokens first, the longest of those that begin at a place, and each is its own id. A long text is encoded
in segments, cut before a blank that follows other than white space, where no token can reach across. No table
of words is kept, so a worker's memory does not depend on what the texts hold.

Defined cases: a null or empty text is the single id 0; repeated rows are packed each; no rows give no rows;
columns beside doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, durable_table
from .hashing import batches

LENGTH = 1024
#: Characters of a text that are encoded at a time.
SEGMENT = 1 << 20
#: How byte-level BPE cuts a text before merging, the bytes that its files write as themselves, and the settings of such a file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SETTINGS = {"normalizer": None, "truncation": None, "padding": None}
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
_encoders: dict[str, Encoder] = {}
# Python's \s holds all that the pattern's does, so nothing is cut that should not be
_blank = re.compile(r"(?<=\S) ")


def checked_settings(file: dict) -> None:
    """Raises if the file asks for more than byte-level BPE by order of ids."""
    for part, wanted in ((file, SETTINGS), (file["pre_tokenizer"] or {}, PRE_TOKENIZER), (file["model"], MODEL)):
        if odd := {k: part.get(k) for k, v in wanted.items() if part.get(k) != v and not (v is False and part.get(k) is None)}:
            raise ValueError(f"tokenizer settings that are not supported: {odd}")
    if odd := [t["content"] for t in file["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or not t["special"]]:
        raise ValueError(f"added tokens of a kind that is not supported: {odd}")
    vocabulary = file["model"]["vocab"]
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("the order of the merges is not that of the ids")


class Encoder:
    """Ids of a byte-level BPE vocabulary as little-endian 32-bit numbers.

    encode_special_tokens is the tokenizers library's: if set, added tokens in a text are read as plain characters.
    """

    def __init__(self, path: str, encode_special_tokens: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        checked_settings(file)
        other = [b for b in range(256) if b not in PRINTED]
        to_byte = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        self._encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._added = {} if encode_special_tokens else special
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if not any(a in text for a in self._added):
            return self._plain(text)
        # every second piece is an added token
        return b"".join(np.array([self._added[x]], "<u4").tobytes() if i % 2 else self._plain(x) for i, x in enumerate(self._cut.split(text)))

    def _plain(self, text: str) -> bytes:
        if len(text) <= SEGMENT:
            return np.array(self._encode(text), "<u4").tobytes()
        found, at = [], 0
        while at < len(text):
            cut = _blank.search(text, at + SEGMENT)
            end = cut.start() if cut else len(text)
            found.append(np.array(self._encode(text[at:end]), "<u4").tobytes())
            at = end
        return b"".join(found)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, part, before (tokens of the partition before it), n, ids (with the end id)."""

    def encode(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        part, before = TaskContext.get().partitionId(), 0
        for batch in tables:
            texts = batch.column("text").to_pylist()
            for begin, end in batches(texts, 1 << 21):
                ids = [coder.ids(t) + b"\0\0\0\0" for t in texts[begin:end]]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.record_batch(
                    [batch.column("doc_id").slice(begin, end - begin), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "before", "n", "ids"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(encode, f"doc_id {kind}, part int, before long, n long, ids binary")


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = durable_table(tokenized(docs, path))
    totals = tokens.groupBy("part").agg(F.sum("n").alias("_total"))
    bases = totals.select("part", (F.sum("_total").over(Window.orderBy("part")) - F.col("_total")).alias("_base"))
    placed = tokens.join(checked_broadcast(bases, totals.count()), "part").withColumn("_at", F.col("_base") + F.col("before"))

    def piece(s):
        begin = F.greatest(s * length - F.col("_at"), F.lit(0))
        size = F.least((s + 1) * length - F.col("_at"), F.col("n")) - begin
        ids = F.substr(F.col("ids"), (begin * 4 + 1).cast("int"), (size * 4).cast("int"))
        return F.struct(begin.alias("start"), size.alias("length"), F.crc32(ids).alias("ids_crc32"), F.col("n").alias("doc_tokens"), s.alias("sequence_id"), (F.col("_at") + begin - s * length).alias("offset"))

    spans = F.sequence(F.floor(F.col("_at") / length), F.floor((F.col("_at") + F.col("n") - 1) / length))
    return placed.select("doc_id", F.transform(spans, piece).alias("_pieces")).select("doc_id", F.inline("_pieces"))
