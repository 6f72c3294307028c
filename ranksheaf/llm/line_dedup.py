"""Line dedup over range-partitioned hashes of lines.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least LEAST code points
that stand in at least DOCUMENTS documents lose all their lines but those of the largest doc_id that holds them.

Every line with such a key becomes a narrow entry: a 128-bit hash of the key, the document, the line's number. The
entries are range-partitioned and sorted by hash, document (the largest first) and line number, all three together, so
a key that a third of all lines share is cut into as many partitions as its entries need. Each partition is streamed
once: of a hash the entries of the first document stay, those of the second wait until a third document comes by, all
later ones go. What waits is one document's lines of one key. A hash that began in an earlier partition, or may go on
in a later one, is settled from boundary records, two a partition at most: its number of documents is the sum over its
partitions less one for each document that a cut went through. The lines that go are returned as one compressed bitmap
a document, never as text; texts meet their bitmaps once, by document.

A bitmap is zlib-compressed and holds a bit a line, the lowest bit of a byte first, 1 for a line that stays; it ends
with the byte of the last line that goes, and all lines after it stay. It is null where no line goes.

Defined cases: null and empty texts have one empty line, which is too short for a key; very long texts and lines are
read whole; rows with one doc_id are one document where documents are counted and where the largest is sought, each
with its own lines; a null doc_id is one document, below every other (it is taken as the least long); a key that stands
in one document only keeps all its lines however often it stands there; no rows give no rows; columns beside doc_id
and text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .common import BROADCAST_BYTES, ascii_lower, broadcast_if_small, delete, durable, durable_table, shared_dir

LEAST, DOCUMENTS = 20, 3
SPACE = " \t\n\x0b\x0c\r"
GOES, WAITS, EDGE = 0, 1, 2
FOUND = "kind int, h1 long, h2 long, d long, t long, pos int, part int, n long, first long, last long"


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, _d and _t, which name a row's document and text, and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("_text")).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_d"), F.xxhash64("_text").alias("_t"), "_text")


def entries(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per line that has a key long enough: its hash, document, text and place."""
    lines = identified(docs).select("_d", "_t", F.posexplode(F.split("_text", "\n")).alias("pos", "_line"))
    lines = lines.select("_d", "_t", "pos", F.btrim("_line", F.lit(SPACE)).alias("_key")).where(F.length("_key") >= least)
    lines = lines.select("_d", "_t", "pos", ascii_lower(F.col("_key")).alias("_key"))
    return lines.select(F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"), F.col("_d").alias("d"), F.col("_t").alias("t"), "pos")


class Stream:
    """One partition of sorted entries, batch by batch."""

    def __init__(self, part: int, documents: int) -> None:
        self.part, self.documents = part, documents
        self.key: tuple[int, int] | None = None  # of the run that is open
        self.first = self.last = self.n = 0  # its first and last document and their number so far
        self.lead = False  # it is the partition's first
        self.waiting: list[np.ndarray] = []  # its second document's entries

    def rows(self, kind: int, x: np.ndarray) -> pa.RecordBatch:
        n, zero = x.shape[1], np.zeros(x.shape[1], np.int64)
        at = [np.full(n, kind, np.int32), *x[:4], x[4].astype(np.int32), np.full(n, self.part, np.int32), zero, zero, zero]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in at], names=[c.split()[0] for c in FOUND.split(", ")])

    def edge(self) -> pa.RecordBatch:
        at = [EDGE, *self.key, 0, 0, 0, self.part, self.n, self.first, self.last]
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(at, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

    def feed(self, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """x: rows h1, h2, d, t, pos of some further entries."""
        h1, h2, d = x[0], x[1], x[2]
        new = np.concatenate(([self.key != (h1[0], h2[0])], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        fresh = new | np.concatenate(([d[0] != self.last], d[1:] != d[:-1]))
        begin, c, run = np.flatnonzero(new), np.cumsum(fresh), np.cumsum(new)
        order = c - np.concatenate(([-self.n], c[begin] - 1))[run]  # of its document among those of its hash
        ends = np.concatenate((begin - 1, [len(d) - 1]))
        totals = np.where(ends >= 0, order[ends], self.n)  # of each run as far as it came, run 0 being the open one
        opening = 1 if self.key is None else 0 if self.lead else -1
        many = (order >= 2) & (totals[run] >= self.documents) & (run != opening)
        short = (order >= 2) & (totals[run] < self.documents) & (run != opening)
        if self.key is not None and self.waiting and totals[0] >= self.documents:
            yield from (self.rows(GOES, w) for w in self.waiting)
            self.waiting = []
        if many.any():
            yield self.rows(GOES, x[:, many])
        if (lead := run == opening).any():
            yield self.rows(WAITS, x[:, lead])
        if len(begin) and self.key is not None:  # the open run has ended
            if self.lead:
                self.n, self.last = totals[0], d[ends[0]] if ends[0] >= 0 else self.last
                yield self.edge()
            self.waiting = []
        if len(begin):
            if opening == 1 and len(begin) > 1:  # the partition's first hash began and ended in this batch
                self.key, self.n, self.first, self.last = (h1[0], h2[0]), totals[1], d[0], d[ends[1]]
                yield self.edge()
            self.lead = opening == 1 and len(begin) == 1
            self.key, self.first = (h1[-1], h2[-1]), d[begin[-1]]
        self.n, self.last = order[-1], d[-1]
        if (wait := short & (run == run[-1])).any():
            self.waiting.append(x[:, wait])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            yield from (self.rows(WAITS, w) for w in self.waiting)
            yield self.edge()


def stream(documents: int):
    """Marks what goes in one partition, what waits for the boundary records, and these records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Stream(TaskContext.get().partitionId(), documents)
        for b in batches:
            if b.num_rows:
                yield from s.feed(np.stack([np.asarray(c).astype(np.int64) for c in b.columns]))
        yield from s.close()

    return run


def dropped(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS, parts: int | None = None) -> DataFrame:
    """d, t, pos of every line that goes; may name a line of repeated rows more than once."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    order = ["h1", "h2", F.desc("d"), "t", "pos"]
    lines = durable_table(entries(docs, least), folder)  # the partitioning reads its input twice: to sample it, and to deal it
    lines = lines.repartitionByRange(parts, *order) if parts else lines.repartitionByRange(*order)
    found = durable(lines.sortWithinPartitions(*order).mapInArrow(stream(documents), FOUND))
    delete(spark, folder)
    by = Window.partitionBy("h1", "h2").orderBy("part")
    edges = found.where(F.col("kind") == EDGE).withColumn("_cut", F.lag("last").over(by) == F.col("first"))
    edges = edges.groupBy("h1", "h2").agg((F.sum("n") - F.count_if("_cut")).alias("_n"), F.max("first").alias("_most")).where(F.col("_n") >= documents)
    # two records a partition at most, however many entries there are
    late = found.where(F.col("kind") == WAITS).join(F.broadcast(edges), ["h1", "h2"]).where(F.col("d") < F.col("_most"))
    return found.where(F.col("kind") == GOES).select("d", "t", "pos").unionByName(late.select("d", "t", "pos"))


@F.pandas_udf(BinaryType())
def bitmap(gone: pd.Series) -> pd.Series:
    def packed(places: np.ndarray) -> bytes:
        bits = np.ones(int(places.max()) // 8 * 8 + 8, np.uint8)
        bits[places] = 0
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes())

    return gone.map(packed)


@F.pandas_udf(StringType())
def kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    """The lines that stay, joined by newlines; null where there is no bitmap."""

    def rest(t: str | None, k: bytes | None) -> str | None:
        if t is None or k is None:
            return None
        lines = t.split("\n")
        stays = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), bitorder="little")[: len(lines)]
        return "\n".join([x for x, s in zip(lines, stays, strict=False) if s] + lines[len(stays) :])

    return pd.Series([rest(t, k) for t, k in zip(text, keep, strict=True)], dtype=object)


def with_bitmaps(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS, parts: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """identified() rows with n_dropped and keep_bitmap."""
    places = dropped(docs, least, documents, parts).groupBy("d", "t").agg(F.collect_set("pos").alias("_gone"))
    marks = durable(places.select(F.col("d").alias("_d"), F.col("t").alias("_t"), F.size("_gone").cast("long").alias("_n"), bitmap("_gone").alias("keep_bitmap")))
    both = identified(docs).join(broadcast_if_small(marks, ["keep_bitmap"], broadcast_bytes), ["_d", "_t"], "left")
    return both.withColumn("n_dropped", F.coalesce("_n", F.lit(0).cast("long"))).drop("_n")


def kept(text: Column, keep: Column) -> Column:
    """The text without the lines that go; texts that lose none never leave the JVM."""
    return F.coalesce(kept_text(F.when(keep.isNotNull(), text), keep), text)


def line_dedup(docs: DataFrame, **how) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_sha256, keep_bitmap."""
    return with_bitmaps(docs, **how).select(
        "doc_id", F.size(F.split("_text", "\n")).cast("long").alias("n_lines"), "n_dropped", F.sha2(kept(F.col("_text"), F.col("keep_bitmap")), 256).alias("kept_sha256"), "keep_bitmap"
    )


SQL = """
WITH l AS (
  SELECT doc_id, pos, lines[pos] AS line
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
m AS (SELECT key, max(doc_id) AS most FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (m.most > k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (m.most IS NULL OR m.most = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN m USING (key) GROUP BY k.doc_id
"""
