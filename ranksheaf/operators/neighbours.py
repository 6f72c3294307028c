"""Nearest neighbours through a partitioned vector index, exactly.

Index: centroids are fitted on a bounded sample (SAMPLE vectors by hash of their id), then every vector is put in the
list of its nearest centroid, with its distance from it. About sqrt(n) lists, LISTS at most.

Search: for a query q, a list with centre c and radius r holds nothing more similar than q.c + |q| r. A query first
visits the PROBES lists of the highest bound; the k-th similarity found there is its threshold. Then it visits every
other list whose bound reaches the threshold, so nothing is missed: recall is 1 whatever the lists are. How many lists
that is depends on the vectors: where they lie in clusters a query visits few, where they are spread evenly over a
sphere of many dimensions no bound excludes a list, and the second round compares with all vectors.

Vectors of a list are dealt to parts of about PART by hash, queries to blocks of about BLOCK, so a list that holds a
third of all vectors, or copies of one, is as many tasks as it needs. A cell (list, part, block) is one matrix product;
it gives each query its k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

SAMPLE, LISTS, ROUNDS, PROBES = 20_000, 4096, 12, 2
PART, BLOCK = 8192, 1024
#: Similarities are compared as rounded to 9 digits; bounds give way by more than that and by what sums round.
SLACK = 1e-8
FOUND = "query_id long, vec_id long, score double"


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def hashed_sample(df: DataFrame, keys: list[str], sample: int, n: int) -> DataFrame:
    """About ``sample`` of n rows by a hash of their keys, twice as many at most; chosen where they are read, so that no task sends more than its share."""
    if n > sample:
        df = df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    return df.limit(2 * sample)


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly taken first centres."""
    centres = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        nearest = (sample @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Lists:
    """Centre, radius, size and number of parts of each list: what tasks need to know of the index."""

    def __init__(self, centres: np.ndarray, known: list) -> None:
        self.centres = centres
        self.radius, self.size = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
        for r in known:
            self.radius[r.list], self.size[r.list] = r.far, r.n
        self.parts = np.maximum(1, -(-self.size // PART))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most similar that each list could hold; -inf for an empty list."""
        return q @ self.centres.T + np.linalg.norm(q, axis=1)[:, None] * self.radius


class Index:
    """The vectors with their lists, stored, and the lists."""

    def __init__(self, vectors: DataFrame, sample: int = SAMPLE, lists: int = LISTS) -> None:
        """vectors: vec_id, doc_id, v (doubles, all of one length)."""
        n = vectors.count()
        drawn = hashed_sample(vectors.select("vec_id", "v"), ["vec_id"], sample, n).select("v").toPandas()["v"] if n else []
        drawn = drawn if len(drawn) or not n else vectors.select("v").limit(1).toPandas()["v"]
        centres = fitted(np.stack(drawn.to_numpy()), max(1, min(lists, round(n**0.5)))) if n else np.zeros((0, 0))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = rows_of(b.column("v"))
                near = (v @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1) if len(v) else np.zeros(0, int)
                far = np.sqrt(((v - centres[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "doc_id", "v")), pa.array(near.astype(np.int32)), pa.array(far)], names=["vec_id", "doc_id", "v", "list", "far"])

        self.rows = stored(vectors.select("vec_id", "doc_id", "v").mapInArrow(assign, "vec_id long, doc_id long, v array<double>, list int, far double"))
        known = self.rows.groupBy("list").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()  # LISTS rows at most
        self.lists = Lists(centres, known)


def visits(lists: Lists, queries: DataFrame, probes: int) -> tuple[DataFrame, DataFrame]:
    """The lists that queries (query_id, q_doc, q and, if known, least) visit in the first round, and in the second."""

    def chosen(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = rows_of(b.column("q"))
                if not len(q):
                    continue
                bound = lists.bounds(q)
                begin = np.argsort(-bound, axis=1, kind="stable")[:, :probes]
                early = np.zeros(bound.shape, bool)
                np.put_along_axis(early, begin, True, axis=1)
                if first:
                    take = early
                else:
                    least = b.column("least").to_numpy(zero_copy_only=False)
                    take = ~early & (bound >= (np.where(np.isnan(least), -np.inf, least) - SLACK)[:, None])
                at, to = np.nonzero(take & np.isfinite(bound))
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(rows) for c in ("query_id", "q_doc", "q")), pa.array(to.astype(np.int32)), pa.array(lists.parts[to].astype(np.int32))], names=["query_id", "q_doc", "q", "list", "parts"]
                )

        return run

    schema = "query_id long, q_doc long, q array<double>, list int, parts int"
    asked = queries.select("query_id", "q_doc", "q", "least")
    return asked.mapInArrow(chosen(True), schema), asked.mapInArrow(chosen(False), schema)


def met(index: Index, visiting: DataFrame, n_queries: int, k: int) -> DataFrame:
    """The k best of each cell for its queries, vectors of the query's own document apart."""
    blocks = max(1, -(-n_queries // BLOCK))
    asked = visiting.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    n_parts = F.array(*(F.lit(int(p)) for p in index.lists.parts)) if len(index.lists.parts) else F.array(F.lit(1))
    sent = index.rows.select("vec_id", "doc_id", "v", "list", F.pmod(F.xxhash64("vec_id"), F.get(n_parts, F.col("list"))).cast("int").alias("part"))
    # a vector goes to the blocks that visit its list, not to all
    open_ = asked.select(F.col("list").alias("_list"), F.col("part").alias("_part"), F.col("block").alias("_block")).distinct()
    sent = sent.join(open_, (F.col("list") == F.col("_list")) & (F.col("part") == F.col("_part"))).select("vec_id", "doc_id", "v", "list", "part", F.col("_block").alias("block"))

    def cell(key: tuple, v: pa.Table, q: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not (v.num_rows and q.num_rows):
            return empty
        vec, doc, own = v.column("vec_id").to_numpy(), v.column("doc_id").to_numpy(), q.column("q_doc").to_numpy()
        score = np.round(rows_of(q.column("q")) @ rows_of(v.column("v")).T, 9)
        score[own[:, None] == doc[None, :]] = -np.inf
        best = -np.partition(-score, k - 1, axis=1)[:, k - 1] if score.shape[1] > k else np.full(len(score), -np.inf)
        at, to = np.nonzero((score >= best[:, None]) & np.isfinite(score))
        order = np.lexsort((vec[to], -score[at, to], at))
        at, to = at[order], to[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        at, to = at[place < k], to[place < k]
        return pa.table({"query_id": q.column("query_id").to_numpy()[at], "vec_id": vec[to], "score": score[at, to]})

    by = ["list", "part", "block"]
    return sent.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(cell, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, index: Index | None = None, probes: int = PROBES) -> DataFrame:
    """query_id, vec_id, score, rank: the k most similar vectors of other documents, ties by vec_id.

    vectors: vec_id, doc_id, v; queries: query_id, q_doc, q.
    """
    index = index or Index(vectors)
    queries = stored(queries.select("query_id", "q_doc", "q"))
    n = queries.count()
    first, _ = visits(index.lists, queries.withColumn("least", F.lit(None).cast("double")), probes)
    early = stored(ranked(met(index, first, n, k), k).drop("rank"))
    known = early.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    _, second = visits(index.lists, queries.join(known, "query_id", "left"), probes)
    return ranked(early.unionByName(met(index, second, n, k)), k)


def pairs_compared(vectors: DataFrame, queries: DataFrame, k: int, index: Index, probes: int = PROBES) -> int:
    """How many similarities nearest() forms: the sizes of the lists visited."""
    queries = stored(queries.select("query_id", "q_doc", "q"))
    first, _ = visits(index.lists, queries.withColumn("least", F.lit(None).cast("double")), probes)
    early = stored(ranked(met(index, first, queries.count(), k), k).drop("rank"))
    known = early.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    _, second = visits(index.lists, queries.join(known, "query_id", "left"), probes)
    lists = first.select("list").unionByName(second.select("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()
    return int(sum(int(index.lists.size[r.list]) * r.n for r in lists))
