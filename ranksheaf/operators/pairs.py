"""The best pairs of unlike candidates, without forming the pairs.

A pair is two candidates of different classes (and, over all documents, of different documents); its score is the sum
of theirs, ties go by (doc_id, pos) of both. If k better candidates could take a candidate's place in each of its pairs,
it is in none of the k best pairs. So of a class and document the k best are enough; over all documents, of a class the
2 k best of those, for at most k of them share the partner's document. What is left, at most 2 k a class however large
the table, are the heads of sorted lists, one a class. The k-th best pair among the first few of them is a threshold:
candidates that miss it even with the best partner of all are dropped, and only the rest is joined, class by class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Heads of the lists from which the threshold comes, for each pair asked for.
HEAD = 16
SIDES = ("doc_id", "pos", "cls", "score")


def best(candidates: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id", "pos")
    return candidates.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")


def joined(heads: DataFrame, classes: list[str], apart: bool) -> DataFrame:
    """Pairs of heads of different classes: doc_a, pos_a, cls_a, doc_b, pos_b, cls_b, pair_score; a before b."""
    names = {"doc_id": "doc", "pos": "pos", "cls": "cls", "score": "score"}
    side = lambda s: heads.select(*(F.col(c).alias(f"_{names[c]}_{s}") for c in SIDES))
    others = F.filter(F.array(*(F.lit(c) for c in classes)), lambda c: c > F.col("_cls_l"))
    left = side("l").withColumn("_other", F.explode(others))
    met = left.join(side("r"), F.col("_other") == F.col("_cls_r")) if apart else left.join(side("r"), (F.col("_doc_l") == F.col("_doc_r")) & (F.col("_other") == F.col("_cls_r")))
    if apart:
        met = met.where(F.col("_doc_l") != F.col("_doc_r"))
    first = F.struct("_doc_l", "_pos_l") < F.struct("_doc_r", "_pos_r")
    pick = lambda c, a, b: F.when(first, F.col(f"_{c}_{a}")).otherwise(F.col(f"_{c}_{b}"))
    return met.select(*(pick(c, *("lr" if s == "a" else "rl")).alias(f"{c}_{s}") for s in "ab" for c in ("doc", "pos", "cls")), (F.col("_score_l") + F.col("_score_r")).alias("pair_score"))


ORDER = ["doc_a", "pos_a", "doc_b", "pos_b"]


def top_pairs(candidates: DataFrame, k: int) -> DataFrame:
    """The k best pairs of different documents and classes. candidates: doc_id, pos, cls, score, unique by (doc_id, pos)."""
    kept = candidates.select(*SIDES).where(F.col("score").isNotNull() & F.col("cls").isNotNull())
    heads = stored(best(best(kept, ["cls", "doc_id"], k), ["cls"], 2 * k))
    classes = sorted(r.cls for r in heads.select("cls").distinct().collect())  # one row a class
    few = heads.orderBy(F.desc("score"), "doc_id", "pos").limit(HEAD * k)
    threshold = joined(few, classes, True).orderBy(F.desc("pair_score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("pair_score").alias("least")).first()
    if threshold.n == k:
        most = heads.agg(F.max("score").alias("m")).first().m
        heads = heads.where(F.col("score") + F.lit(most) >= F.lit(threshold.least))
    ranked = joined(heads, classes, True).orderBy(F.desc("pair_score"), *ORDER).limit(k)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pair_score"), *ORDER)).cast("long"))


def top_pairs_within(candidates: DataFrame, k: int) -> DataFrame:
    """The k best pairs of different classes of each document, with their rank."""
    heads = best(candidates.select(*SIDES).where(F.col("score").isNotNull() & F.col("cls").isNotNull()), ["doc_id", "cls"], k)
    classes = sorted(r.cls for r in candidates.select("cls").distinct().where("cls IS NOT NULL").collect())
    order = Window.partitionBy("doc_a").orderBy(F.desc("pair_score"), "pos_a", "pos_b")
    return joined(heads, classes, False).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
