"""How many candidates to keep: pool sizes, pool algebra, adaptive and oracle cut-offs, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZES = [1, 2, 3, 5, 10, 20, 50]


def with_parameter(df: DataFrame, name: str, values: list) -> DataFrame:
    """Every row once per value of a short list of parameters: one scan for a whole sweep."""
    return df.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))


def size_sweep(e: DataFrame, sizes: list[int] = SIZES) -> DataFrame:
    """Per pool size: mean pool size, share of questions with any gold, share of gold found, of the two lists' union."""
    best = e.withColumn("best", F.least("rd", "rb"))
    rows = with_parameter(best.select("doc_id", "best", "is_gold", "n_gold"), "pool_n", sizes)
    per = rows.groupBy("pool_n", "doc_id", "n_gold").agg(F.count_if(F.col("best") <= F.col("pool_n")).alias("size"), F.count_if((F.col("best") <= F.col("pool_n")) & (F.col("is_gold") == 1)).alias("found"))
    return per.groupBy(F.col("pool_n").cast("long").alias("pool_n")).agg(
        F.round(F.avg("size"), 6).alias("mean_size"), F.round(F.avg((F.col("found") > 0).cast("double")), 6).alias("recall"),
        F.round(F.sum("found") / F.sum("n_gold"), 6).alias("ref_recall"), F.round(F.avg(F.col("found") / (F.col("size") + F.col("n_gold") - F.col("found"))), 6).alias("iou_full"),
    )


def algebra(e: DataFrame, n: int) -> DataFrame:
    """Sizes and gold of dense, BM25, their union and intersection, at top n."""
    d, b = F.col("rd") <= n, F.col("rb") <= n
    sets = {"bm25": b, "dense": d, "intersection": d & b, "union": d | b}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("pool"), v.alias("inside")) for k, v in sets.items())))
    rows = e.select("doc_id", "is_gold", each.alias("s")).select("doc_id", "is_gold", "s.*")
    return rows.groupBy("pool").agg(
        F.round(F.count_if("inside") / F.count_distinct("doc_id"), 6).alias("mean_size"), F.count_if(F.col("inside") & (F.col("is_gold") == 1)).alias("gold_found"), F.sum("is_gold").alias("gold")
    )


def contribution(e: DataFrame, n: int) -> DataFrame:
    """Gold paragraphs by which list finds them."""
    d, b = F.col("rd") <= n, F.col("rb") <= n
    who = F.when(d & b, "both").when(d, "dense only").when(b, "bm25 only").otherwise("neither")
    return e.where("is_gold = 1").groupBy(who.alias("found_by")).agg(F.count(F.lit(1)).alias("n"))


def bucket_of(n: Column, most: int = 5) -> Column:
    return F.when(n <= most, n.cast("string")).otherwise(F.lit(f"{most + 1}+"))


def bucket_recall(e: DataFrame, n: int) -> DataFrame:
    """Micro and macro recall by number of gold paragraphs."""
    per = e.groupBy("doc_id", "n_gold").agg(F.count_if((F.col("rd") <= n) & (F.col("is_gold") == 1)).alias("found"))
    return per.groupBy(bucket_of(F.col("n_gold")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("found") / F.sum("n_gold"), 6).alias("micro"), F.round(F.avg(F.col("found") / F.col("n_gold")), 6).alias("macro"), F.round(F.avg((F.col("found") > 0).cast("double")), 6).alias("hit")
    )


def adaptive(e: DataFrame, kind: str, values: list[float], score: str = "dense", rank: str = "rd", most: int = 5) -> DataFrame:
    """Keep while the gap to the top, the score or the ratio to the top allows, at most ``most``; at least the first."""
    top = F.first(score).over(Window.partitionBy("doc_id").orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = with_parameter(e.withColumn("top", top).where(F.col(rank) <= most), "value", [float(v) for v in values])
    s, v = F.col(score), F.col("value")
    keep = {"gap": F.round(F.col("top") - s, 9) <= v, "threshold": s > v, "ratio": (F.col("top") > 0) & (F.round(F.try_divide(s, F.col("top")), 9) >= v)}[kind] | (F.col(rank) == 1)
    per = rows.groupBy("value", "doc_id", "n_gold").agg(F.count_if(keep).alias("k"), F.count_if(keep & (F.col("is_gold") == 1)).alias("found"))
    return per.groupBy("value").agg(F.round(F.avg("k"), 6).alias("mean_k"), F.round(F.avg(F.col("found") / (F.col("k") + F.col("n_gold") - F.col("found"))), 6).alias("iou"))


def best_value(sweep: DataFrame, by: str = "iou", order: str = "value") -> DataFrame:
    """The best configuration; of equals the first."""
    return sweep.orderBy(F.desc(by), order).limit(1)


def oracle_k(e: DataFrame, rank: str = "rd") -> DataFrame:
    """IoU when exactly as many are kept as there are gold ones."""
    per = e.groupBy("doc_id", "n_gold").agg(F.count_if((F.col(rank) <= F.col("n_gold")) & (F.col("is_gold") == 1)).alias("found"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("found") / (2 * F.col("n_gold") - F.col("found"))), 6).alias("iou"))


def best_iou(e: DataFrame, most: int, rank: str = "rd") -> DataFrame:
    """Per cut-off up to ``most``: the mean over questions of the best IoU at any smaller cut-off."""
    w = Window.partitionBy("doc_id").orderBy(rank)
    rows = e.where(F.col(rank) <= most).withColumn("found", F.sum("is_gold").over(w)).withColumn("iou", F.col("found") / (F.col(rank) + F.col("n_gold") - F.col("found")))
    rows = rows.withColumn("best", F.max("iou").over(w))
    return rows.groupBy(F.col(rank).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("best"), 6).alias("best_iou"))


def citation_rate(rank: Column, rates: list[float]) -> Column:
    """How often rank r is cited: the first always, the next ones as measured, later ones falling by a fifth each, 0.05 at least."""
    known = F.element_at(F.array(*(F.lit(x) for x in rates)), F.least(rank, F.lit(len(rates))).cast("int"))
    rest = F.greatest(F.lit(0.05), F.lit(rates[-1]) * F.pow(F.lit(0.8), rank - len(rates)))
    return F.when(rank == 1, F.lit(1.0)).when(rank <= len(rates), known).otherwise(rest)


def simulated_citations(e: DataFrame, rates: list[float], seed: str = "cite", rank: str = "rd") -> DataFrame:
    """Paragraphs that a model would cite if it always cited rank 1 and the others with a fixed rate; hash-seeded."""
    return e.withColumn("cited", is_cited(F.col("pos"), F.col(rank), rates, seed))


def is_cited(pos: Column, rank: Column, rates: list[float], seed: str = "cite") -> Column:
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "doc_id", pos)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (u < citation_rate(rank, rates)).cast("long")


def number_cited(chances: Column) -> Column:
    """The distribution of how many of independent unequal draws succeed: chance of 0, 1, 2 and so on."""
    spread = lambda d, p: F.zip_with(F.concat(d, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), d), lambda miss, hit: miss * (1 - p) + hit * p)
    return F.aggregate(chances, F.array(F.lit(1.0)), spread)


def expected_iou(e: DataFrame, rates: list[float], most: int, rank: str = "rd") -> DataFrame:
    """doc_id, expected_k and expected_iou of that model over the first ``most`` ranks, exact instead of drawn.

    With h of the gold ones cited and m of the others, IoU is h / (n_gold + m); h and m are sums of independent draws.
    """
    rows = e.where(F.col(rank) <= most).withColumn("_p", citation_rate(F.col(rank), rates))
    chances = lambda gold: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_gold") == gold, F.struct(rank, "_p")))), lambda x: x["_p"])
    per = rows.groupBy("doc_id", "n_gold").agg(chances(1).alias("_g"), chances(0).alias("_o"), F.round(F.sum("_p"), 9).alias("expected_k"))
    per = per.select("doc_id", "n_gold", "expected_k", number_cited(F.col("_g")).alias("_h"), number_cited(F.col("_o")).alias("_m"))
    inner = lambda h, ph: F.aggregate(F.transform("_m", lambda pm, m: F.coalesce(F.try_divide(ph * pm * h, (F.col("n_gold") + m).cast("double")), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    iou = F.aggregate(F.transform("_h", lambda ph, h: inner(h, ph)), F.lit(0.0), lambda s, x: s + x)
    return per.select("doc_id", "expected_k", iou.alias("expected_iou"))


def average_k(e: DataFrame, mean: float, seed: str = "avg", rank: str = "rd") -> DataFrame:
    """cited: the first ranks up to the whole part of ``mean`` always, the next one with its fraction as chance; hash-seeded per question."""
    whole, part = int(mean), mean - int(mean)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    r = F.col(rank)
    return e.withColumn("cited", ((r <= whole) | ((r == whole + 1) & (u < round(part, 9)))).cast("long"))


def strategies(sizes: tuple[int, ...] = (5, 10, 20), alphas: tuple[float, ...] = (0.3, 0.5, 0.7)) -> dict[str, Column]:
    """Pool strategies by name: whether a paragraph with ranks rd, rb, rr (fused) and w30, w50, w70 (weighted) is in."""
    found: dict[str, Column] = {}
    for n in sizes:
        d, b = F.col("rd") <= n, F.col("rb") <= n
        found |= {f"dense_{n}": d, f"bm25_{n}": b, f"union_{n}": d | b, f"intersection_{n}": d & b, f"rrf_{n}": F.col("rr") <= n}
        found |= {f"weighted{round(100 * a)}_{n}": F.col(f"w{round(100 * a)}") <= n for a in alphas}
    return found | {"all": F.lit(True)}


def strategy_table(ranked: DataFrame, inside: dict[str, Column]) -> DataFrame:
    """Per strategy: mean pool size, share of questions with any gold, share of gold found, IoU of the whole pool."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("strategy"), v.alias("inside")) for k, v in inside.items())))
    rows = ranked.select("doc_id", "is_gold", "n_gold", each.alias("s")).select("doc_id", "is_gold", "n_gold", "s.*")
    per = rows.groupBy("strategy", "doc_id", "n_gold").agg(F.count_if("inside").alias("size"), F.count_if(F.col("inside") & (F.col("is_gold") == 1)).alias("found"))
    return per.groupBy("strategy").agg(
        F.round(F.avg("size"), 6).alias("size"), F.round(F.avg((F.col("found") > 0).cast("double")), 6).alias("recall"), F.round(F.sum("found") / F.sum("n_gold"), 6).alias("ref_recall"),
        F.round(F.avg(F.col("found") / (F.col("size") + F.col("n_gold") - F.col("found"))), 6).alias("iou_full"), F.min("size").alias("least"), F.max("size").alias("most"),
    )


def shape(rows: DataFrame, score: str = "dense") -> DataFrame:
    """How a question's scores fall off: gap and ratio to the second, how many are near the top, mean and deviation of five; within rows that hold all scores of a question as an array."""
    d = rows.select("doc_id", F.inline(F.array(F.struct(F.sort_array(score, asc=False).alias("d")))))
    top, second, five = F.get("d", F.lit(0)), F.get("d", F.lit(1)), F.slice("d", 1, 5)
    over = lambda share: F.size(F.filter("d", lambda x: x >= share * top)).cast("long")
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def more(m: Column, x: Column) -> Column:  # Welford's update, as aggregates do it
        n, delta = m["n"] + 1, x - m["mean"]
        return F.struct(n.alias("n"), (m["mean"] + delta / n).alias("mean"), (m["m2"] + delta * (delta - delta / n)).alias("m2"))

    return d.select(
        "doc_id", F.round(top - second, 6).alias("gap"), F.round(F.coalesce(F.try_divide(second, F.greatest(top, F.lit(1e-9))), F.lit(0.0)), 6).alias("ratio"), over(0.5).alias("over_half"), over(0.9).alias("near_top"),
        F.round(F.aggregate(five, F.lit(0.0), lambda s, x: s + x) / F.size(five), 6).alias("mean5"), F.round(F.aggregate(five, none, more, lambda m: F.sqrt(m["m2"] / m["n"])), 6).alias("std5"),
    )


def policy_iou(e: DataFrame, policies: dict[str, Column], rank: str = "rd") -> DataFrame:
    """Mean IoU when a policy says how many to keep; a policy may use n_gold and the question's shape."""
    rows = e.withColumn("p", F.explode(F.array(*(F.struct(F.lit(k).alias("policy"), v.cast("long").alias("k")) for k, v in policies.items())))).select("*", "p.policy", "p.k")
    per = rows.where(F.col(rank) <= F.col("k")).groupBy("policy", "doc_id", "n_gold").agg(F.count(F.lit(1)).alias("size"), F.sum("is_gold").alias("found"))
    return per.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("found") / (F.col("size") + F.col("n_gold") - F.col("found"))), 6).alias("iou"))
