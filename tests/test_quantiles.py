import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksheaf.operators import analysis, quantiles


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v double, y long")


def rows(kind):
    rng = random.Random(kind)
    if kind == "one group holds all":
        return [("hot", rng.gauss(0, 1), i % 3 // 2) for i in range(5000)] + [("cold", 1.0, 1)]
    if kind == "one value holds most":
        return [("a", 7.0 if i % 4 else rng.random(), i % 2) for i in range(3000)] + [(None, float(i), i % 2) for i in range(11)]
    return [(rng.choice("abc"), float(rng.randrange(5)), rng.randrange(2)) for _ in range(400)] + [("nulls", None, 1), ("a", None, 0)]


KINDS = ["one group holds all", "one value holds most", "few values"]


def of(rows, k):
    return np.array([v for key, v, _ in rows if key == k and v is not None])


@pytest.mark.parametrize("bins", [4, 256])
@pytest.mark.parametrize("kind", KINDS)
def test_percentiles_are_exact(spark, kind, bins):
    r, shares = rows(kind), [0.0, 0.05, 0.5, 0.9, 0.99, 1.0]
    got = {x.k: x for x in quantiles.linear(table(spark, r).repartition(5), "v", ["k"], shares, bins).collect()}
    assert set(got) == {k for k, v, _ in r if v is not None}
    for k, x in got.items():
        assert x.n == len(of(r, k)) and x.p == pytest.approx(np.percentile(of(r, k), [100 * s for s in shares]), abs=1e-12)


@pytest.mark.parametrize("kind", KINDS)
def test_places_of_a_group(spark, kind):
    r = rows(kind)
    ranks = lambda n: F.array(F.lit(1).cast("long"), F.floor((n + 1) / 2).cast("long"))
    for x in quantiles.at_ranks(table(spark, r), "v", ["k"], lambda n: F.array_distinct(ranks(n)), 8).collect():
        ordered = sorted((v for k, v, _ in r if k == x.k), key=lambda v: (v is not None, v or 0.0))
        assert x.found == [ordered[i - 1] for i in sorted({1, (len(ordered) + 1) // 2})]


@pytest.mark.parametrize("bins", [3, 256])
@pytest.mark.parametrize("kind", KINDS)
def test_rank_sums(spark, kind, bins):
    r = rows(kind)
    got = {x.k: x for x in quantiles.rank_sums(table(spark, r).repartition(7), "v", "y", ["k"], bins).collect()}
    for k in got:
        v, y = of(r, k), np.array([y for key, v, y in r if key == k and v is not None])
        ranks = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        assert (got[k].ranks, got[k].p, got[k]["all"]) == (ranks[y == 1].sum(), y.sum(), len(v))


def test_no_task_gets_a_group_whole(spark):
    """The windows that order values are split by range beside the group."""
    df = table(spark, rows("one group holds all"))
    plan = quantiles.linear(df, "v", ["k"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan
    windows = [x for x in plan.split("\n") if "Window [" in x or "windowspecdefinition" in x]
    ordered_by_value = [x for x in windows if "v#" in x]
    assert ordered_by_value and all("_bin#" in x for x in ordered_by_value)


def test_summaries_of_empty_and_null_groups(spark):
    df = table(spark, [("a", None, 1), ("b", 2.0, 0)])
    got = {r.k: (r.n, r.p50, r.least) for r in analysis.percentiles(df, "v", ["k"]).collect()}
    assert got == {"a": (0, None, None), "b": (1, 2.0, 2.0)}
    assert analysis.percentiles(table(spark, []), "v", ["k"]).count() == 0
    assert analysis.rank_sum_auc(table(spark, []), "v", "y", ["k"]).count() == 0
