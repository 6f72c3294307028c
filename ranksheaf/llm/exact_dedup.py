"""Exact dedup by a tree merge of sorted digest runs.

Every input partition is a leaf whose digests become a run, one entry per text. In each round ``fan_in``
neighbouring runs exchange their entries by digest and are merged into one, so after log(partitions) rounds a
single run, dealt out by digest, names the row that stays of every text. The decision then goes down the same
tree. A task never sees more than ``fan_in`` entries of a text in a round, and at the leaves no more rows than
its input partition holds: a text that a third of all rows share needs no special case.

The merge of a round is Spark's sort aggregation: it sorts what the exchange brings and combines neighbours of
equal key in one pass. DataFrames have no operator that takes runs as already sorted across an exchange, nor one
that keeps the order of a full outer join, so runs are not stored in order; each round orders them anew.

Texts are equal when identical after lower-casing A-Z. An entry's key holds two witnesses beside SHA-256,
the byte length and an independent 64-bit hash; entries merge only if all three agree, at every level.

Defined cases: null text counts as the empty text; empty texts are equal to each other; of repeated rows
with one doc_id one stays; a null doc_id is below every other; no rows give no rows; columns beside doc_id
and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checked_broadcast, durable

KEY = ["_sha", "_bytes", "_hash"]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the key of its text, its leaf and its row's number."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", text.alias("_text")).select(
        "doc_id",
        F.unhex(F.sha2("_text", 256)).alias("_sha"),
        F.octet_length("_text").alias("_bytes"),
        F.xxhash64("_text").alias("_hash"),
        F.spark_partition_id().alias("_run"),
        F.monotonically_increasing_id().alias("_row"),
    )


def exact_dedup(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = durable(digests(docs))
    level = rows.groupBy(*KEY, "_run").agg(F.max(F.struct("doc_id", "_row")).alias("_best"), F.count(F.lit(1)).alias("_size"))
    leaves = (rows.agg(F.max("_run")).first()[0] or 0) + 1
    levels = [durable(level)]
    while leaves > 1:
        merged = levels[-1].withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
        merged = merged.groupBy(*KEY, "_run").agg(F.max("_best").alias("_best"), F.sum("_size").alias("_size"))
        levels.append(durable(merged))
        leaves = -(-leaves // fan_in)
    winner = levels.pop()
    for run in reversed(levels):
        down = winner.withColumnRenamed("_run", "_up")
        members = run.select(*KEY, "_run", F.floor(F.col("_run") / fan_in).cast("int").alias("_up"))
        winner = members.join(down, [*KEY, "_up"]).drop("_up")
    return rows.join(winner, [*KEY, "_run"]).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_best._row") == F.col("_row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    found = durable(exact_dedup(docs))
    per_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max("kept").alias("_any"))
    gone = durable(per_id.where(~F.col("_any") | (F.col("_n") > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias("_gone"), "_any"))
    n = gone.count()
    here = docs.join(checked_broadcast(gone.select("_gone"), n), docs["doc_id"].eqNullSafe(F.col("_gone")), "left_anti")
    if gone.where("_any").isEmpty():
        return here
    # ids that stand in several rows: here the text decides beside the id
    sha = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    again = docs.join(gone.where("_any").select("_gone"), docs["doc_id"].eqNullSafe(F.col("_gone")), "left_semi").withColumn("_sha", sha)
    stays = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_stays"))
    again = again.join(stays, again["doc_id"].eqNullSafe(stays["_id"]) & (again["_sha"] == stays["_stays"]), "left_semi")
    return here.unionByName(again.dropDuplicates(["doc_id", "_sha"]).drop("_sha"))


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
