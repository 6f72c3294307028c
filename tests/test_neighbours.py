import numpy as np
import pytest

from conftest import SMALL
from ranksheaf.operators import neighbours, vectors

SCHEMA = "vec_id long, doc_id long, v array<double>"


def clustered(n, seed=1, clusters=40, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    v = centres[rng.integers(clusters, size=n)] + 0.05 * rng.normal(size=(n, width))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, ids=None, doc=lambda i: i // 5):
    ids = range(len(v)) if ids is None else ids
    return spark.createDataFrame([(int(i), int(doc(i)), [float(x) for x in r]) for i, r in zip(ids, v, strict=True)], SCHEMA)


def asked(df):
    return df.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "doc_id AS q_doc", "v AS q")


def brute(rows, k):
    out = {}
    v = np.array([r.v for r in rows])
    for q in rows:
        if q.vec_id % 50 == 0:
            score = np.round(v @ np.array(q.v), 9)
            best = sorted((-s, r.vec_id) for s, r in zip(score, rows, strict=True) if r.doc_id != q.doc_id)[:k]
            out[q.vec_id] = [(i, -s) for s, i in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def close(got, want):
    assert set(got) == {q for q, x in want.items() if x}
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-9)


@pytest.mark.parametrize("k", [1, 3])
def test_clustered_vectors(spark, k):
    df = frame(spark, clustered(1500)).repartition(5)
    close(found(neighbours.nearest(df, asked(df), k)), brute(df.collect(), k))


def test_a_third_are_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 64)
    monkeypatch.setattr(neighbours, "BLOCK", 5)
    v = clustered(900)
    v[::3] = v[0]
    df = frame(spark, v, ids=[i * 10**9 + (0 if i % 2 else 50) * i for i in range(900)], doc=lambda i: i % 7)
    rows = df.collect()
    close(found(neighbours.nearest(df, asked(df), 2)), brute(rows, 2))


def test_vectors_of_any_length_and_odd_tables(spark):
    v = np.random.default_rng(3).normal(size=(260, 3)) * np.array([10, 1, 0.01])
    v[7] = 0
    df = frame(spark, v)
    close(found(neighbours.nearest(df, asked(df), 4)), brute(df.collect(), 4))
    one = frame(spark, v[:1])
    assert neighbours.nearest(one, asked(one), 2).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(none, asked(none), 2).count() == 0


def test_the_driver_s_vectors_in_full(spark):
    df = vectors.placed(spark.read.parquet(f"{SMALL}/embeddings.parquet")).select("vec_id", "doc_id", "v")
    close(found(vectors.nearest(df, 2)), brute(df.collect(), 2))


def test_pairs_grow_slower_than_the_square(spark):
    """With four times the vectors brute force forms sixteen times the pairs."""
    n = {}
    for size in (1000, 4000):
        df = frame(spark, clustered(size, clusters=60))
        n[size] = neighbours.pairs_compared(df, asked(df), 2, neighbours.Index(df))
    assert n[4000] < 8 * n[1000] and n[4000] < 0.25 * 4000 * 80
