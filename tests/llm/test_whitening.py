import math

import numpy as np
import pytest

from conftest import SMALL
from ranksheaf.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<double>, x string, n long"


def brute(rows, components=4):
    """vec_id -> (n, deviation, whitened, explained) with the matrix library's own eigenvectors."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = np.array([[math.floor(256 * c) for c in v] + [0] * (width - len(v)) for _, v in kept], object).reshape(len(kept), width)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit * n - s).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    w = ((x * n - s).astype(float) / n) @ vectors / np.sqrt(np.maximum(values, 1e-300))
    return [(i, n, int(((n * r - s) ** 2).sum()), w[k], values / max(1e-300, np.trace(centred.T @ centred / n))) for k, (i, r) in enumerate(zip([i for i, _ in kept], x, strict=True))]


def compared(got, want, close=1e-7):
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    signs = {}
    assert {(i, d) for i, _, d, _, _ in want} == set(by)
    assert len(got) == sum(len(w) for *_, w, _ in want)
    for i, n, d, w, e in want:
        for k, v in enumerate(w, 1):
            r = by[i, d][k]
            assert r.n == n and r.explained == pytest.approx(e[k - 1], rel=1e-9)
            if abs(v) > 1e-3:
                assert signs.setdefault(k, np.sign(v * r.whitened)) == np.sign(v * r.whitened)
                assert abs(r.whitened) == pytest.approx(abs(v), rel=close)


def test_agrees_with_the_whole_spectrum(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = registry.op13_whitening(spark, SMALL).collect()
    assert len(got) == 4 * len(rows)
    compared(got, brute(rows), 1e-6)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_odd_cases(spark):
    rng = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [1.0, None, 2.0]), (3, [nan, 1.0, 1.0]), (4, [inf, 0.0, 0.0]), (5, []), (6, [1.0]), (None, [0.5, -0.001, 0.25]), (7, [-0.0, 0.0, 1e-9]), (7, [-0.0, 0.0, 1e-9]), (8, [0.0, -0.0])]
    rows = odd + [(100 + i, [float(c) for c in rng.normal(size=3) * (1, 5, 0.2)]) for i in range(200)] + [(400 + i, [0.25, 0.5, 0.75]) for i in range(100)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(7)
    got = whitening.whiten(df).collect()
    want = brute(rows)
    assert len(got) == 3 * len(want)
    compared(got, want)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [float("nan")])], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).count() == 0


def test_directions_without_spread_are_null(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "", 0), (2, [1.0, 2.0], "", 0)], SCHEMA)).collect()
    assert all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one) and len(one) == 4
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i], "", 0) for i in range(9)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line)
    assert all(r.identity_error < 1e-9 for r in line) and {round(r.explained, 12) for r in line if r.component == 1} == {1.0}


def test_sums_stay_exact_for_huge_entries(spark):
    rows = [(i, [1e12 * i, float(i * i), -3e11]) for i in range(8)] + [(9, [1e300, 0.0, 0.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()}
    assert got[0, 1].deviation is None and got[0, 1].n == 9
    assert got[9, 1].whitened is not None


@pytest.mark.parametrize("values", [[9, 4, 1, 0.5, 0.1, 0.01], [5, 5, 5, 5, 5, 5], [3, 3, 2, 2, 2, 2, 2, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5 - 1e-12, 0.1], [1], [2, 0, 0, 0, 0], list(np.linspace(1, 0.9, 40)), [1e-12] * 3 + [1e6]])
def test_contour_finds_every_eigenpair(values):
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.standard_normal((len(values),) * 2))[0]
    a = basis @ np.diag(values) @ basis.T
    a = (a + a.T) / 2
    got, vectors = whitening.leading(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][:4]
    assert got == pytest.approx(want, abs=1e-12 * max(values))
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() < 1e-12 * max(values)


def test_inertia_counts():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    t, values = whitening.tridiagonal(a), np.linalg.eigvalsh(a)
    for s in (-100, -3.3, 0.01, 2.5, 100):
        assert whitening.inertia(t, s) == (values < s).sum()
