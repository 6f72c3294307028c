"""Quality classifier by importance resampling.

Two generative models over hashed words and word pairs are counted: the target's from labelled good
documents, the raw one's from all documents. A document's log weight is the mean over its words and pairs of
log p_target - log p_raw, both shrunk towards the raw model by PRIOR expected occurrences, times UNITS: every
document weighs as one of UNITS words and pairs, so that its length does not decide. Documents are then drawn
without replacement in proportion to their weight by Gumbel top-k: a Gumbel variate, from a hash of the
document's id, is added to the log weight and the k largest are kept.

UNITS is the temperature of the draw. On the labels that train, 0.08 a word lie between the least 1 % of good
documents and the best 5 % of bad ones; times 50 that is four nats, a few deviations of the variate, so
documents near the border are drawn by chance and those far from it are not. k is the number of documents whose
log weight is at or above the cut that best parts the held-out labels, a lost good document counting LOSS
times a kept bad one, as a filter should keep clean documents.

The raw model counts every document. The labelled rows used are a sample of at most LABELLED, by hash of their
id, with which the documents are met by a broadcast join (of rows with the same id one is used); a third of them
(crc32(id) mod 3 = 1) is held out and picks the cut. Labels with crc32(id) mod 10 = 7 are not used at all:
accuracy is reported on these, and no constant may be chosen by them.
The top k are found by narrowing a histogram of all keys, so no sort of the corpus and no gathering of scores is
needed. Counts come to the driver as one fixed-size vector of BUCKETS numbers a model.

Defined cases: a null or empty text has weight 0 and is kept like any other of that weight; with no labelled
rows of both kinds all documents are kept; equal keys at the cut are all kept; a null doc_id draws as the empty
string; repeated rows share their fate; no rows give no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import checked_broadcast, durable, one_each

BUCKETS, LABELLED, LOSS, PRIOR, UNITS = 1 << 16, 20_000, 10, 20.0, 50.0
SEED = "gumbel-1"


def buckets_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and pairs of all texts, and each text's number of buckets; a text's words come first."""
    w, counts = hashing.words_of(texts)
    ends = np.cumsum(counts)
    pairs = hashing.grams(w, 2)
    inside = np.ones(len(pairs), bool)
    inside[(ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(w))] - 1)] = False
    text = np.repeat(np.arange(len(texts)), counts)
    owner = np.concatenate((text, text[:-1][inside] if len(pairs) else text[:0]))
    both = np.concatenate((w, pairs[inside])) >> np.uint64(48)
    return both.astype(np.int64), owner


def _counted(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(BUCKETS, np.int64)
    for batch in tables:
        texts = batch.column("text").to_pylist()
        for begin, end in hashing.batches(texts):
            sums += np.bincount(buckets_of(texts[begin:end])[0], minlength=BUCKETS)
    used = np.flatnonzero(sums)
    yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["bucket", "n"])


def counts(docs: DataFrame) -> np.ndarray:
    """How often every bucket occurs."""
    rows = docs.select("text").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log p_target - log p_raw of every bucket; what the target's size lets expect less than about ``prior`` times says little."""
    expected = raw * target.sum() / max(raw.sum(), 1.0)
    return np.log((target + prior) / (expected + prior))


def weighed(docs: DataFrame, ratio: np.ndarray, more: list[str] = ()) -> DataFrame:
    """doc_id, the further columns and log_weight."""

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            texts, out = batch.column("text").to_pylist(), []
            for begin, end in hashing.batches(texts):
                found, owner = buckets_of(texts[begin:end])
                n = np.bincount(owner, minlength=end - begin)
                out.append(UNITS * np.bincount(owner, ratio[found], end - begin) / np.maximum(n, 1))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", *more)), pa.array(np.round(np.concatenate(out or [np.zeros(0)]), 9))], names=["doc_id", *more, "log_weight"])

    kinds = dict(docs.dtypes)
    return docs.select("doc_id", *more, "text").mapInArrow(work, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *more)) + ", log_weight double")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 48))


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 2048) -> float:
    """The k-th largest value, exactly, by counting in ever narrower bins."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) / bins
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        inside = keys.where(F.col(column).between(low, high))
        found = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("bin")).collect()
        for row in found:
            if k <= row["n"]:
                break
            k -= row["n"]
        if (row["lo"], row["hi"]) == (low, high):
            return float(low if k > inside.where(F.col(column) > low).count() else high)
        low, high = row["lo"], row["hi"]
    return float(low)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The log weight that loses least: LOSS for a good document below it, 1 for a bad one at or above it, both as shares."""
    values = np.concatenate((good, bad))
    order = np.argsort(values, kind="stable")
    step = np.where(order < len(good), LOSS / len(good), -1.0 / len(bad))
    cost = np.concatenate(([0.0], np.cumsum(step)))
    v = np.concatenate(([-np.inf], values[order]))
    i = int(np.argmin(cost))
    return float((v[i] + v[i + 1]) / 2 if 0 < i < len(order) else v[min(i + 1, len(order))])


def unused(doc_id: Column) -> Column:
    """Whether the document's label is of the fold that neither trains, cuts nor tunes."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 10 == 7


def importance_resampling(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, log_weight, key (with the Gumbel variate), kept."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~unused(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = sample.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(LABELLED)
    sample = durable(sample)
    known = durable(one_each(docs.join(F.broadcast(sample), "doc_id"), ["quality", "held_out"]))
    ratio = log_ratio(counts(known.where("quality = 1 AND NOT held_out")), counts(docs))
    marked = weighed(known, ratio, ["quality", "held_out"]).where("held_out").select("quality", "log_weight").toPandas()
    good, bad = (marked.loc[marked["quality"] == q, "log_weight"].to_numpy() for q in (1, 0))
    gumbel = -F.log(-F.log(uniform(F.col("doc_id"))))
    keyed = durable(weighed(docs, ratio).withColumn("key", F.col("log_weight") + gumbel))
    if not len(good) or not len(bad):
        return keyed.withColumn("kept", F.lit(True))
    k = keyed.where(F.col("log_weight") >= best_cut(good, bad)).count()
    if k == 0:
        return keyed.withColumn("kept", F.lit(False))
    return keyed.withColumn("kept", F.col("key") >= kth_largest(keyed, "key", k))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that were not drawn."""
    found = importance_resampling(docs, labels)
    gone = durable(found.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(checked_broadcast(gone, gone.count()), docs["doc_id"].eqNullSafe(F.col("_gone")), "left_anti")
