import numpy as np
import pytest

from ranksheaf.operators import late

CACHE, ASKED = "doc_id long, pos long, vectors array<array<float>>", "query_id long, doc_id long, vectors array<array<float>>"


def tables(spark, seed=1, documents=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, 8))
    some = lambda n: [[float(x) for x in v] for v in (centre[rng.integers(12, size=n)] + 0.1 * rng.normal(size=(n, 8))).astype(np.float32)]
    cache = [(d, p, some(rng.integers(0, 9))) for d in range(documents) for p in range(1, 40)]
    asked = [(10 * d + i, d, some(rng.integers(0, 4))) for d in range(documents + 1) for i in range(3)]
    return cache, asked


@pytest.mark.parametrize("k,codes", [(1, 12), (5, 64), (100, 3)])
def test_ranking_is_that_of_scoring_all(spark, k, codes):
    cache, asked = tables(spark)
    got = {}
    for r in late.ranked(spark.createDataFrame(asked, ASKED), spark.createDataFrame(cache, CACHE).repartition(5), k, codes).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.pos, r.score)
    for q, d, v in asked:
        scores = sorted((-(np.array(v) @ np.array(p).T).max(axis=1).sum() if v and p else 0.0, pos) for doc, pos, p in cache if doc == d)[:k]
        want = {i: (pos, -s) for i, (s, pos) in enumerate(scores, 1)}
        assert {i: p for i, (p, _) in got.get(q, {}).items()} == {i: p for i, (p, _) in want.items()}
        assert all(got[q][i][1] == pytest.approx(want[i][1], abs=1e-6) for i in want)


def test_bounds_spare_most_paragraphs(spark):
    rng = np.random.default_rng(3)
    centre = np.eye(16)
    cache = [(0, p, [[float(x) for x in centre[(p + j) % 16] + 0.01 * rng.normal(size=16)] for j in range(3)]) for p in range(800)]
    asked = [(7, 0, [[float(x) for x in centre[i]] for i in (2, 3, 4)])]
    r = late.ranked(spark.createDataFrame(asked, ASKED), spark.createDataFrame(cache, CACHE), 3, 16).collect()
    assert [x.pos % 16 for x in r] == [2, 2, 2] and r[0].n_scored < 200


def test_nothing_cached(spark):
    cache, asked = spark.createDataFrame([], CACHE), spark.createDataFrame([(1, 1, [[1.0]])], ASKED)
    assert late.ranked(asked, cache, 3).count() == 0
    empty = spark.createDataFrame([(1, 2, []), (1, 1, None)], CACHE)
    assert [(r.pos, r.score) for r in late.ranked(asked, empty, 3).orderBy("rank").collect()] == [(1, 0.0), (2, 0.0)]


def test_codes_of_paragraphs(spark):
    one, two = [1.0, 0.0], [0.0, 1.0]
    cache = spark.createDataFrame([(1, 1, [one, two, one]), (1, 2, []), (1, 3, [two] * 2), (1, 4, None)], "doc_id long, pos long, vectors array<array<double>>").coalesce(1)
    got = late.coded(cache, np.array([one, two])).orderBy("pos").collect()
    assert [r.flat for r in got] == [[1.0, 0.0, 0.0, 1.0, 1.0, 0.0], [], [0.0, 1.0, 0.0, 1.0], []]
    assert [r.codes for r in got] == [[0, 1], [], [1], []] and got[0].far == [0.0, 0.0]


def test_documents_share_the_calls_of_python(spark):
    cache, asked = tables(spark, documents=2)
    plan = late.ranked(spark.createDataFrame(asked, ASKED), spark.createDataFrame(cache, CACHE), 3)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and plan.count("MapInArrow") == 2
