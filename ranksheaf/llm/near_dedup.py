"""MinHash near-dedup by an inverted join on signature coordinates.

1. Every text becomes the set of its distinct 5-word shingles and, from it, a signature of K minima.
   Texts with the same set form a class; from here on a class is one node, however many copies it has.
2. Nodes are posted under their (coordinate, value) pairs. Two nodes with the wanted similarity agree in at
   least T of K coordinates, but for a chance of about 1e-7. So a node needs T pairs that some other node has
   too, and of these, rarest first, all but T - 1 are its prefix: two such nodes meet in a prefix pair.
   Lists of common values are thereby skipped; agreement in them is counted from the signatures.
3. Shingles that a node shares with no other node bound what it can have in common with any. A node of more
   than 15 % such shingles leaves, and so on while many leave; a pair whose bounds are too low is no candidate.
4. Within a list not all pairs are emitted. In a first round each node of a list meets the list's pivot only,
   the node with the smallest share of shingles of its own, in a second one a pivot by hash. What is linked
   then forms components, and only nodes of one list that are still in different components are paired. A
   group of m near copies costs about m links, not m squared.
5. A candidate counts its agreeing coordinates, and if there are T, its full shingle sets are intersected.

Texts are read twice: for the signatures, and for the sets of nodes that have a prefix. Links, components and
sets stay in Spark; only counts come to the driver. Hot keys: copies collapse before any join, lists are
joined with their pivot through join_with_hot_keys, and pair joins are inner joins that AQE can split.

Defined cases: null, empty and white-space texts have an empty set, size 0, and are linked with nothing, not
even with each other; repeated rows and equal texts fall in one class; a null doc_id counts in its class but
never names it unless the class has no other; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import checked_broadcast, delete, durable, durable_table, join_with_hot_keys, shared_dir

WORDS, LEAST = 5, 85
K, T = 64, 39
ROUNDS, PEELS = 2, 3
#: If both nodes' own shingles are over a share of (100 - LEAST) / LIGHT, the pair's bound is below LEAST %.
LIGHT = 100 + LEAST
FACTORS = hashing.mixed(np.arange(1, 4096, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _sets(texts: list[str | None]) -> Iterator[list[np.ndarray]]:
    """Shingle sets, a few texts at a time."""
    for begin, end in hashing.batches(texts):
        all_words, counts = hashing.words_of(texts[begin:end])
        ends = np.cumsum(counts)
        yield [hashing.shingle_set(all_words[e - c : e], WORDS) for c, e in zip(counts, ends, strict=True)]


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def _signed(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tables:
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        done = 0
        for sets in _sets(texts):
            full = [s for s in sets if len(s)]
            minima = np.zeros((len(full), K), np.uint32)
            if full:
                hashes, starts = np.concatenate(full), np.cumsum([0, *map(len, full[:-1])])
                for k in range(K):
                    minima[:, k] = np.minimum.reduceat(hashes * FACTORS[k], starts) >> np.uint64(32)
            rows = iter(minima.view(np.int32))
            yield pa.record_batch(
                [
                    ids.slice(done, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array([next(rows) if len(s) else None for s in sets], pa.list_(pa.int32())),
                ],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )
            done += len(sets)


def _full(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tables:
        for sets in _sets(batch.column("text").to_pylist()):
            full = [s for s in sets if len(s)]
            yield pa.record_batch(
                [pa.array([_digest(s) for s in full], pa.binary()), pa.array([s.view(np.int64) for s in full], pa.list_(pa.int64()))],
                names=["digest", "shingles"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; empty if that is), signature."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_signed, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, digest binary, signature array<int>")


def prefixes(nodes: DataFrame) -> DataFrame:
    """node, n, k, v: the pairs that a node is posted under."""
    posts = nodes.select("node", "n", F.posexplode("signature").alias("k", "v"))
    often = posts.groupBy("k", "v").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    known = posts.join(often, ["k", "v"]).groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("often", "k", "v"))).alias("known"))
    known = known.where(F.size("known") >= T).withColumn("known", F.slice("known", F.lit(1), F.size("known") - T + 1))
    return known.select("node", "n", F.inline("known")).select("node", "n", "k", "v")


def peeled(sets: DataFrame) -> DataFrame:
    """node, shared (number of its shingles that stand in some other node too) of the nodes that can have a partner."""
    alive, before = sets, sets.count()
    for _ in range(PEELS):
        each = alive.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("often"), F.min("node").alias("node"))
        lonely = each.where("often = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lonely"))
        n = alive.select("node", F.size("shingles").cast("long").alias("n")).join(lonely, "node", "left").withColumn("shared", F.col("n") - F.coalesce("lonely", F.lit(0)))
        left = durable(n.where(100 * F.col("shared") >= LEAST * F.col("n")).select("node", "shared"))
        after = left.count()
        if 10 * after > 9 * before:
            break
        alive, before = sets.join(checked_broadcast(left, after), "node", "left_semi"), after
    return left


def may_link(n_a: Column, shared_a: Column, n_b: Column, shared_b: Column) -> Column:
    """Whether the sets could be similar enough, if all that either shares with any were common to both."""
    most = F.least(shared_a, shared_b)
    return 100 * most >= LEAST * (n_a + n_b - most)


def agreeing(a: str, b: str) -> Column:
    """In how many coordinates two signatures collide."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, x: s + x)


def _with(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    for x in ("b", "a"):
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col(column).alias(f"{column}_{x}")), x)
    return pairs


def matching(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Of pairs a, b those that agree in T coordinates."""
    return _with(pairs, signed, "signature").where(agreeing("signature_a", "signature_b") >= T).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs a, b those whose sets are similar enough."""
    pairs = _with(pairs, sets, "shingles")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    pairs = pairs.select("a", "b", both.alias("both"), (F.size("shingles_a") + F.size("shingles_b")).alias("sum"))
    return pairs.where(100 * F.col("both") >= LEAST * (F.col("sum") - F.col("both"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node that has a link; root is the smallest node reachable.

    In each round every vertex is hooked to its neighbour of least rank, if that is below its own, the chains of
    hooks are followed to their ends by pointer jumping, and each tree becomes one vertex. Ranks are hashes, so
    at least half of the vertices with a link hook in a round on average, whatever the ids and the graph's
    shape: rounds are logarithmic in the number of nodes. Steps are kept as tables, not as checkpoints, which
    carry the constraints of all plans before them along.
    """
    spark = links.sparkSession
    folder = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
    kept = lambda df: durable_table(df, folder)
    rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("node"))
    edges = kept(links.where("a <> b").select("a", "b").distinct())
    found = None
    while not edges.isEmpty():
        ways = edges.select("a", "b").union(edges.select("b", "a"))
        least = ways.groupBy("a").agg(F.min(rank("b")).alias("near"), F.first(rank("a")).alias("own"))
        to = kept(least.select(F.col("a").alias("node"), F.when(F.col("near") < F.col("own"), F.col("near.node")).otherwise(F.col("a")).alias("root")))
        while True:
            on = to.select(F.col("node").alias("root"), F.col("root").alias("_on"))
            new = kept(to.join(on, "root").select("node", F.col("_on").alias("root"), (F.col("_on") != F.col("root")).alias("_new")))
            to = new.select("node", "root")
            if new.where("_new").isEmpty():
                break
        for x in ("a", "b"):
            edges = edges.join(to.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")), x).drop(x).withColumnRenamed(f"_{x}", x)
        edges = kept(edges.where("a <> b").select("a", "b").distinct())
        if found is None:
            found = to
        else:
            later = to.select(F.col("node").alias("root"), F.col("root").alias("_on"))
            found = kept(found.join(later, "root", "left").select("node", F.coalesce("_on", "root").alias("root")))
    if found is None:
        found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = kept(found.groupBy("root").agg(F.min("node").alias("_least"), F.count(F.lit(1)).alias("_n")))
    out = durable_table(join_with_hot_keys(found, named, ["root"], "_n", found.count()).select("node", F.col("_least").alias("root")))
    delete(spark, folder)
    return out


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, n_shingles, digest; one row per class: digest, members, component_id)."""
    signed = durable(signatures(docs))
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(
        F.first("signature").alias("signature"), F.first("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("members")
    )
    nodes = durable(classes.withColumn("node", F.monotonically_increasing_id()))
    posts = durable(prefixes(nodes))
    used = durable(posts.select("node").distinct())
    n_used = used.count()
    keys = nodes.select("node", "digest", "doc_id", "signature").join(checked_broadcast(used, n_used), "node", "left_semi")
    wanted = keys.select(F.col("doc_id").alias("_id"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(checked_broadcast(wanted.distinct(), n_used), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = texts.mapInArrow(_full, "digest binary, shingles array<long>").join(keys.select("node", "digest"), "digest")
    sets = durable(found.groupBy("node").agg(F.first("shingles").alias("shingles")))
    able = peeled(sets)
    posts = posts.join(checked_broadcast(able, able.count()), "node").withColumn("post", F.shiftleft(F.col("k").cast("long"), 32) + F.col("v"))
    posts = durable(posts)
    n_posts = posts.count()

    links, tried, roots = None, None, None
    for turn in range(ROUNDS):
        order = F.xxhash64("node", F.lit(turn)).cast("double") if turn else F.lit(1.0) - F.col("shared") / F.col("n")
        first = F.min(F.struct(order.alias("order"), "node", "n", "shared"))
        pivots = posts.groupBy("k", "v").agg(first.alias("p"), F.count(F.lit(1)).alias("often"))
        pivots = pivots.where("often > 1").select("k", "v", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.shared").alias("pivot_shared"), "often")
        met = join_with_hot_keys(posts, pivots, ["k", "v"], "often", n_posts).where((F.col("pivot") != F.col("node")) & may_link(F.col("n"), F.col("shared"), F.col("pivot_n"), F.col("pivot_shared")))
        pairs = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = durable(pairs)
        new = durable(confirmed(matching(pairs, keys), sets))
        tried = pairs if tried is None else tried.union(pairs)
        links = new if links is None else links.union(new)
    roots = components(links)
    # the rest: pairs in one list whose nodes are still apart
    placed = posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = placed.groupBy("k", "v").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("k", "v")
    placed = placed.join(apart, ["k", "v"], "left_semi")
    # a list's largest component is never paired with itself, and of any pair one node must be light
    main = placed.groupBy("k", "v", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("k", "v").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
    whole = posts.groupBy("node").agg(F.collect_list("post").alias("all")).join(keys.select("node", "signature"), "node")
    placed = placed.join(main, ["k", "v"]).join(whole, "node")
    placed = durable(placed.select("k", "v", "post", "root", "node", "n", "shared", "all", "signature", (F.col("root") == F.col("main")).alias("main")))
    side = lambda df, x: df.select("k", "v", *(F.col(c).alias(f"{c}_{x}") for c in ("root", "node", "n", "shared", "all", "post", "signature")))
    placed = placed.withColumn("light", LIGHT * (F.col("n") - F.col("shared")) <= (100 - LEAST) * F.col("n"))
    light = placed.where("light")
    rest = side(light.where("main"), "a").join(side(placed.where("NOT main"), "b"), ["k", "v"]).unionByName(side(light.where("NOT main"), "a").join(side(placed.where("NOT (main AND light)"), "b"), ["k", "v"]))
    rest = rest.where((F.col("root_a") != F.col("root_b")) & may_link(F.col("n_a"), F.col("shared_a"), F.col("n_b"), F.col("shared_b")))
    # a pair is made in the first of the lists that both are in, and only if enough coordinates collide
    rest = rest.where((F.array_min(F.array_intersect("all_a", "all_b")) == F.col("post_a")) & (agreeing("signature_a", "signature_b") >= T))
    rest = rest.withColumnsRenamed({"node_a": "a", "node_b": "b"})
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    late = durable(confirmed(durable(rest), sets))
    if not late.isEmpty():
        roots = components(links.union(late))
    named = nodes.select("node", "digest", "members", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return signed.select("doc_id", "n_shingles", "digest"), named.join(least, "root").select("digest", "members", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows, classes = near_classes(docs)
    classes = durable(classes)
    total = classes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    full = join_with_hot_keys(rows.where("n_shingles > 0"), classes, ["digest"], "members", total)
    out = full.select("doc_id", "n_shingles", "component_id").unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """docs without the documents that near_dedup drops, with all columns."""
    found = near_dedup(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = durable(found.where("NOT kept").select(F.col("doc_id").alias("_gone")))
    return docs.join(checked_broadcast(gone, gone.count()), docs["doc_id"].eqNullSafe(F.col("_gone")), "left_anti")
