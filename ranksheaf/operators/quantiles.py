"""Exact order statistics of groups of any size.

Rows are counted per group and value first, so equal values are one row from then on. The values of all groups are cut
into BINS ranges at approximate quantiles of these rows; the cuts come from a sketch and decide the work, never the
result. Each group's ranges are then summed, and prefix sums over them, BINS rows a group at most, tell how many rows
lie below each range. What a place in a range needs is its own range only: no task sorts or holds a group's values.

Nulls are below every value where places are asked for, and left out of percentiles and rank sums. A null key is a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Ranges of values; a range holds about a share 1 / BINS of all groups' distinct values.
BINS = 256


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys meet."""
    other = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, on, how).drop(*(f"_r_{k}" for k in keys))


def binned_counts(df: DataFrame, column: str, keys: list[str], bins: int = BINS, more: dict[str, Column] | None = None) -> DataFrame:
    """keys, column, _c (rows with that value), _bin and the sums ``more``, one row per group and value."""
    sums = {name: F.sum(c) for name, c in (more or {}).items()}
    counts = stored(df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_c"), *(s.alias(name) for name, s in sums.items())))
    found = counts.agg(F.percentile_approx(column, [i / bins for i in range(1, bins)], 20 * bins)).first()[0] or []
    cuts = sorted(set(found))
    step = max(1, round(len(cuts) ** 0.5))  # coarse cuts first, then those of one step
    over = lambda cs: F.size(F.filter(F.array(*(F.lit(float(c)) for c in cs)), lambda c: c < F.col(column)))
    steps = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = over([c[-1] for c in steps]) if steps else F.lit(0)
    each = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in steps)) if steps else F.array(F.array().cast("array<double>"))
    fine = F.size(F.filter(F.coalesce(F.get(each, coarse), F.array().cast("array<double>")), lambda c: c < F.col(column)))
    return counts.withColumn("_bin", F.when(F.col(column).isNull(), F.lit(-1)).otherwise(coarse * step + fine))


def below(counts: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """keys, _bin, the totals of ``sums`` (column -> its name here) in the range, and _below_<name>, in all ranges before it."""
    per = counts.groupBy(*keys, "_bin").agg(*(F.sum(c).alias(name) for c, name in sums.items()))
    w = Window.partitionBy(*keys).orderBy("_bin")
    return per.select("*", *((F.sum(name).over(w) - F.col(name)).alias(f"_below_{name}") for name in sums.values()))


def at_ranks(df: DataFrame, column: str, keys: list[str], ranks: Callable[[Column], Column], bins: int = BINS) -> DataFrame:
    """keys, n and found: the values (double) at the 1-based places that ``ranks`` (an array of distinct longs) makes of n."""
    spare = [] if keys else ["_all"]
    df = df if keys else df.withColumn("_all", F.lit(1))
    by = keys or spare
    counts = binned_counts(df, column, by, bins)
    place = below(counts, by, {"_c": "_total"})
    n = counts.groupBy(*by).agg(F.sum("_c").alias("n"))
    wanted = n.select(*by, "n", F.explode(ranks(F.col("n"))).alias("_rank"))
    wanted = matched(wanted, place, by).where((F.col("_rank") > F.col("_below__total")) & (F.col("_rank") <= F.col("_below__total") + F.col("_total")))
    ranges = wanted.groupBy(*by, "_bin").agg(F.first("_below__total").alias("_before"), F.collect_list("_rank").alias("_ranks"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_bin").orderBy(column))
    rows = matched(counts, ranges, [*by, "_bin"]).withColumn("_upto", F.col("_before") + upto)
    inside = F.filter("_ranks", lambda r: (r <= F.col("_upto")) & (r > F.col("_upto") - F.col("_c")))
    hits = rows.select(*by, F.col(column).cast("double").alias("_v"), F.explode(inside).alias("_rank"))
    found = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_v"))), lambda x: x["_v"])
    return matched(hits.groupBy(*by).agg(found.alias("found")), n, by).select(*keys, "n", "found")


def linear(df: DataFrame, column: str, keys: list[str], shares: list[float], bins: int = BINS) -> DataFrame:
    """keys, n and p: percentiles by linear interpolation between the two neighbouring places."""
    place = lambda n, s: F.lit(s) * (n - 1)
    low = lambda n, s: F.floor(place(n, s)).cast("long") + 1
    high = lambda n, s: F.ceil(place(n, s)).cast("long") + 1
    ranks = lambda n: F.array_sort(F.array_distinct(F.array(*(f(n, s) for s in shares for f in (low, high)))))
    rows = at_ranks(df.where(F.col(column).isNotNull()), column, keys, ranks, bins).withColumn("_ranks", ranks(F.col("n")))
    value = lambda r: F.get("found", (F.array_position("_ranks", r) - 1).cast("int"))

    def between(s: float) -> Column:
        n = F.col("n")
        a, b, at = low(n, s), high(n, s), place(n, s)
        return F.when(a == b, value(a)).otherwise((b - 1 - at) * value(a) + (at - (a - 1)) * value(b))

    return rows.select(*keys, "n", F.array(*(between(s) for s in shares)).alias("p"))


def rank_sums(df: DataFrame, score: str, label: str, keys: list[str], bins: int = BINS) -> DataFrame:
    """keys, all (rows), p (positives) and ranks: the sum of the positives' ranks, equal scores sharing their mean rank."""
    by = keys or ["_all"]
    df = (df if keys else df.withColumn("_all", F.lit(1))).where(F.col(score).isNotNull())
    counts = binned_counts(df, score, by, bins, {"_pos": F.col(label)})
    here = F.sum("_c").over(Window.partitionBy(*by, "_bin").orderBy(score)) - F.col("_c")
    inside = counts.withColumn("_at", F.col("_pos") * (here + (F.col("_c") + 1) / 2.0)).groupBy(*by, "_bin").agg(F.sum("_at").alias("_inside"))
    place = below(counts, by, {"_c": "_n", "_pos": "_p"})
    place = matched(place, inside, [*by, "_bin"])
    return place.groupBy(*by).agg(F.sum(F.col("_inside") + F.col("_p") * F.col("_below__n")).alias("ranks"), F.sum("_p").alias("p"), F.sum("_n").alias("all")).select(*keys, "ranks", "p", "all")
