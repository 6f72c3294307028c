"""Mixing sources to target weights.

Tokens are summed per source, the targets follow by water-filling, a source's repetition rate is its target
over its size, and every document is taken floor(rate) times plus one more time with the fraction as
probability. Each document's draw has exactly that probability and comes from hashes of the seed, so reruns
agree. The draws of a source are tied to each other so that its words come near its target even with few or
very uneven documents: its documents stand in order of size class, ties by hash, and with one uniform offset u
a source the document at position r gets the copy if floor((r + 1) * f + u) is over floor(r * f + u).

Water-filling in one pass: with the sources ordered by cap / weight, the capped ones come first. A source is
capped if its ratio is below the level that it and the rest would share after all before it were capped;
the level of the first that is not holds for all after it.

Independent draws (tied=False) miss the targets by more: one standard deviation of a source's words is up to 28 %
of its target with 50 documents a source, 12 % with 500, and 5 % in a source of 18,700 documents of which 7 % are
taken, because few very long documents hold many of the words.

Positions come from counts per stratum (source, size class, hash block): sums over the classes of a source and
over the blocks of a class give each stratum's first position, a window within the stratum the rest. A block
holds about BLOCK documents of all sources together, so the hot source's strata are as small as any. Only narrow rows (id, source, size) are shuffled. The
per-source sums are ordered in one task, one row a source. Tables of sources and strata are broadcast behind
a check of their number; beyond it hot keys are broadcast alone and the rest is joined by a shuffle.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source whose
documents are all empty has target 0; repeated rows are drawn for each on its own; a null doc_id is hashed as
the empty string; no rows give no rows; columns beside doc_id, source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checked_broadcast, durable, join_with_hot_keys, word_count

SEED = "mix-1"
CAP = 3
#: Documents of all sources in a hash block.
BLOCK = 100_000


def targets(sums: DataFrame, cap: int = CAP, weights: int = 3) -> DataFrame:
    """_null, source, source_size, n -> the same with the source's target in words."""
    by_name = Window.orderBy("_null", "source")
    by_ratio = Window.orderBy("_ratio", "_null", "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = sums.withColumn("_weight", ((F.row_number().over(by_name) - 1) % weights + 1).cast("long"))
    t = t.withColumn("_cap", F.col("source_size") * cap).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weight = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    t = t.withColumn("_level", left / weight)
    t = t.withColumn("_open", F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(everything))
    open_ = F.col("_ratio") >= F.col("_level")
    return t.select("_null", "source", "source_size", "n", F.when(open_, F.col("_weight") * F.col("_open")).otherwise(F.col("_cap").cast("double")).alias("target"))


def uniform(name, seed: str = SEED):
    """In [0, 1), from 48 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return bits.cast("double") / F.lit(float(1 << 48))


def size_class(size):
    """Four classes to a doubling, by the leading bits."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(bits * 4 + F.expr("shiftright(size, length(bin(size)) - 3)").bitwiseAND(F.lit(3))).cast("int")


def _joined(left: DataFrame, right: DataFrame, key: list[str], rows: int, total: int) -> DataFrame:
    """right is unique in key and has n, the left rows that it meets; n is dropped."""
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop("n")), key)
    return join_with_hot_keys(left, right, key, "n", total)


def mix(docs: DataFrame, cap: int = CAP, seed: str = SEED, tied: bool = True) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies. If not tied, every draw is on its own."""
    return _mixed(docs, cap, seed, tied).drop("_null", "source", "_t")


def _mixed(docs: DataFrame, cap: int, seed: str, tied: bool = True) -> DataFrame:
    """mix() with what else names a row: its source (as _null and source) and its text's hash, _t."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_t"))
    sized = durable(sized.withColumn("_null", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit(""))))
    sums = sized.groupBy("_null", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goals = durable(targets(sums, cap))
    sources, total = goals.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-total // BLOCK))
    place = sized.withColumn("_hash", uniform(F.col("doc_id"), seed))
    if not tied:
        both = _joined(place, goals, ["_null", "source"], sources, total).withColumn("_rate", _rate())
        return _copies(both, F.col("_hash") < F.col("_rate") - F.floor("_rate"))
    place = place.withColumn("_class", size_class(F.col("size"))).withColumn("_block", F.floor(F.col("_hash") * blocks).cast("int"))
    stratum = ["_null", "source", "_class", "_block"]
    strata = durable(place.groupBy(*stratum).agg(F.count(F.lit(1)).alias("n")))
    # where a size class begins in its source, then where a stratum begins in its class
    first = lambda n, order: F.sum(n).over(order) - F.col(n)
    classes = strata.groupBy(*stratum[:3]).agg(F.sum("n").alias("_in"), F.count(F.lit(1)).alias("_strata"))
    classes = durable(classes.withColumn("_base", first("_in", Window.partitionBy(*stratum[:2]).orderBy(F.desc("_class")))))
    within = strata.withColumn("_within", first("n", Window.partitionBy(*stratum[:3]).orderBy("_block"))).withColumnRenamed("n", "_n")
    within = _joined(within, classes.select(*stratum[:3], "_base", F.col("_strata").alias("n")), stratum[:3], classes.count(), strata.count())
    strata = durable(within.select(*stratum, F.col("_n").alias("n"), (F.col("_base") + F.col("_within")).alias("_first")))
    ranked = place.withColumn("_rank", F.row_number().over(Window.partitionBy(*stratum).orderBy(F.desc("size"), "_hash", "doc_id", "_t")) - 1)
    both = _joined(_joined(ranked, strata, stratum, strata.count(), total), goals, ["_null", "source"], sources, total)
    both = both.withColumn("_rate", _rate()).withColumn("_u", uniform(F.concat(F.lit("source:"), "source"), seed)).withColumn("_at", F.col("_first") + F.col("_rank"))
    part = F.col("_rate") - F.floor("_rate")
    extra = F.floor((F.col("_at") + 1) * part + F.col("_u")) > F.floor(F.col("_at") * part + F.col("_u"))
    return _copies(both, extra)


def _rate():
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def _copies(rated: DataFrame, extra) -> DataFrame:
    return rated.withColumn("copies", F.floor("_rate") + extra.cast("long")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "_null", "source", "_t"
    )


def mixed_documents(docs: DataFrame, cap: int = CAP, seed: str = SEED, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with every row as often as the mix takes it; the same rows in every run.

    A row is named by its doc_id, source and text together, so rows that share an id, or have none, are told apart and
    spread. Rows alike in all three share their copies evenly, what is over going by a hash of all their columns.
    """
    name = ["doc_id", "_null", "source", "_t"]
    taken = _mixed(docs, cap, seed).groupBy(*name).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where(F.col("_copies") > 0)
    taken = durable(taken.select(*(F.col(c).alias(f"_r{i}") for i, c in enumerate(name)), "_copies", "_rows"))
    own = [F.col("doc_id"), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.xxhash64("text")]
    both = docs.join(checked_broadcast(taken, taken.count(), broadcast_rows), [c.eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(own)])
    # rows alike: their copies are dealt out among them
    again = both.where("_rows > 1").withColumn("_nth", F.row_number().over(Window.partitionBy(*(f"_r{i}" for i in range(4))).orderBy(F.xxhash64(*docs.columns))))
    share = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_nth") <= F.col("_copies") % F.col("_rows")).cast("long")
    repeated = lambda df, n: df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
    return repeated(both.where("_rows = 1"), F.col("_copies")).unionByName(repeated(again, share))


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT) AS w FROM sums),
ratios AS (SELECT *, CAST(source_size * 3 AS DOUBLE) / w AS ratio FROM weighed),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER o, 0) AS DOUBLE)
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
  FROM ratios WINDOW o AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         CASE WHEN ratio >= level THEN w * max(CASE WHEN ratio >= level THEN level END) OVER ()
              ELSE CAST(source_size * 3 AS DOUBLE) END AS target
  FROM levels),
rates AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS h,
         CAST(CAST('0x' || substr(md5('mix-1:source:' || coalesce(s.source, '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u,
         CASE WHEN s.size < 8 THEN s.size ELSE length(bin(s.size)) * 4 + ((s.size >> CAST(length(bin(s.size)) - 3 AS BIGINT)) & 3) END AS class
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
placed AS (
  SELECT *, rate - floor(rate) AS part,
         row_number() OVER (PARTITION BY source ORDER BY class DESC, floor(h * greatest(1, ceil((SELECT count(*) FROM sized) / 100000.0))), size DESC, h, doc_id) - 1 AS pos
  FROM rates),
drawn AS (
  SELECT *, CAST(floor(rate) + CASE WHEN floor((pos + 1) * part + u) > floor(pos * part + u) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM placed)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM drawn
"""
