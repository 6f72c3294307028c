"""Dense vectors: ranking within a document, blends, nearest neighbours, centrality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets
from . import neighbours

PER_DOCUMENT, QUERY_EVERY = 25, 50


def placed(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v (doubles), doc_id: consecutive vectors are the paragraphs of a document."""
    doc = F.floor(F.col("vec_id") / PER_DOCUMENT).cast("long")
    return embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"), doc.alias("doc_id"))


def within_documents(vectors: DataFrame) -> DataFrame:
    """Every vector as a query against the others of its document: query_id, vec_id, score, is_gold (same label), rank."""
    q = vectors.select("doc_id", F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"), F.col("v").alias("q"))
    pairs = q.join(vectors, "doc_id").where(F.col("query_id") != F.col("vec_id"))
    s = pairs.select("doc_id", "query_id", "vec_id", (F.col("label") == F.col("q_label")).cast("long").alias("is_gold"), F.round(sets.dot(F.col("q"), F.col("v")), 9).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("long"))


def summed(vectors: DataFrame, group: str) -> DataFrame:
    """group, n, s: number and sum of the group's vectors, of whatever width the table's are."""
    width = vectors.select(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    sums = vectors.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)))
    return sums.select(group, "n", F.array(*(f"s{i}" for i in range(width))).alias("s"))


def blend_sweep(vectors: DataFrame, alphas: list[float]) -> DataFrame:
    """hit@1 and MRR when each query is moved by alpha towards its document's mean vector."""
    mean = summed(vectors, "doc_id").select("doc_id", F.transform("s", lambda x: x / F.col("n")).alias("h"))
    q = vectors.join(mean, "doc_id").select("doc_id", F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"), F.explode(F.array(*(F.lit(a) for a in alphas))).alias("alpha"), "v", "h")
    q = q.select("doc_id", "query_id", "q_label", "alpha", sets.blended(F.col("v"), F.col("h"), F.col("alpha")).alias("q"))
    pairs = q.join(vectors, "doc_id").where(F.col("query_id") != F.col("vec_id"))
    s = pairs.select("alpha", "query_id", "vec_id", (F.col("label") == F.col("q_label")).alias("gold"), F.round(sets.dot(F.col("q"), F.col("v")), 7).alias("score"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("alpha", "query_id").orderBy(F.desc("score"), "vec_id")))
    per = r.groupBy("alpha", "query_id").agg(F.max((F.col("gold") & (F.col("rank") == 1)).cast("double")).alias("hit1"), F.coalesce(1.0 / F.min(F.when(F.col("gold"), F.col("rank"))), F.lit(0.0)).alias("mrr"))
    return per.groupBy("alpha").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit1"), 4).alias("hit1"), F.round(F.avg("mrr"), 4).alias("mrr"))


def nearest(vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of other documents for every query vector (id divisible by 50), exactly, through a partitioned index."""
    queries = vectors.where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("doc_id").alias("q_doc"), F.col("v").alias("q"))
    return neighbours.nearest(vectors, queries, k)


def centrality(vectors: DataFrame, group: str) -> DataFrame:
    """Mean similarity to the other vectors of the group, from the group's sum: (v.S - v.v) / (n - 1)."""
    both = vectors.join(summed(vectors, group), group)
    mean = F.try_divide(sets.dot(F.col("v"), F.col("s")) - sets.dot(F.col("v"), F.col("v")), (F.col("n") - 1).cast("double"))
    return both.select("vec_id", group, F.round(F.coalesce(mean, F.lit(0.0)), 6).alias("centrality"))


def hashed_token_vectors(tokens: Column) -> Column:
    """Each token as its two hash buckets; two tokens' similarity is the share of common buckets."""
    part = lambda h, at: (F.conv(F.substring(h, at, 4), 16, 10).cast("int") % 64).cast("int")
    return F.transform(F.transform(tokens, F.md5), lambda h: F.array(part(h, 1), part(h, 5)))


def max_sim_buckets(question: Column, paragraph: Column) -> Column:
    """Late interaction over such vectors, without writing out their zeros."""
    same = lambda a, b: ((a[0] == b[0]).cast("double") + (a[1] == b[1]).cast("double")) / 2.0
    best = F.transform(question, lambda q: F.coalesce(F.array_max(F.transform(paragraph, lambda p: same(q, p))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
