"""Embedding whitening: the leading principal components of a table of vectors, found by FEAST contour integration.

Every entry c becomes the whole number floor(256 * c), so that sums over the table are exact in any order. The fit list
is each distinct vector of such numbers once. Over it two rounds of small aggregates are formed: the number and the sums
per dimension, then the products y_i * y_j with y = x - round(mean), exact whole numbers summed by (i, j).
The covariance follows exactly, (n * sum(y_i * y_j) - R_i * R_j) / n**2 with R = sum(y), and is rounded once. Only this
matrix, as large as the vectors are wide, comes to the driver.

There the spectrum is cut by inertia: the matrix is brought to tridiagonal form, and the signs of the pivots of T - s
tell how many eigenvalues lie below any s. Bisection on this count finds where the leading eigenvalues lie and the
widest gap below them. FEAST then works on the interval above the gap: Gauss-Legendre nodes on a circle around it,
a complex shifted solve of the covariance at each, and their weighted sum projects a block of start vectors onto the
interval's eigenspace; Rayleigh-Ritz on that block gives eigenpairs, and the block goes through the contour again
until the residuals are at rounding level. As many eigenpairs must lie in the interval as the inertia count says;
otherwise the block is widened, and the job fails if it is as wide as the matrix and still misses one.

A last pass over the table projects every row; the covariance of the whitened fit list is measured, not assumed.

Defined cases: null vectors and vectors with a null, NaN or infinite entry are dropped; a vector narrower than the
widest has 0 in the entries it lacks (an empty vector too); entries beyond 2**55 in size are taken as that; repeated
rows count once in the fit list and each is returned; a null vec_id is returned as null; components are the first
min(COMPONENTS, width); of equal eigenvalues any basis may come, the same for all rows; where a component's eigenvalue
is zero to rounding (one distinct vector, constant dimensions) whitened is null and identity_error leaves it out, and is
null if none is left; explained is null where the trace is 0; deviations beyond a long are null; no rows give no rows;
columns beside vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable_table

SCALE, COMPONENTS = 256, 4
LIMIT = 1 << 55
#: Nodes on the half circle, rounds through the contour, how far below the leading eigenvalues a gap is sought.
NODES, ROUNDS, LOOK = 8, 40, 12
EXACT = 1 << 53


# the table as whole numbers


def whole(c: Column) -> Column:
    """floor(256 * c) of finite doubles, as long."""
    far = F.lit(float(LIMIT))
    return F.transform(c, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, far), -far)).cast("long"))


def finite_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows that stay."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(good(x), F.lit(False))))
    return kept.select("vec_id", whole(F.col("embedding")).alias("x"))


def matrix(x: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers, short rows filled with 0."""
    lengths = x.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(x), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
    return out


class Moments:
    """n, exact sums and covariance of the fit list, and its rounded mean."""

    def __init__(self, n: int, sums: list[int], centre: np.ndarray, products: dict[tuple[int, int], int]) -> None:
        self.n, self.sums, self.centre, self.width = n, sums, centre, len(sums)
        rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
        self.covariance = np.zeros((self.width, self.width))
        for (i, j), p in products.items():
            self.covariance[i, j] = self.covariance[j, i] = float(Fraction(n * p - rest[i] * rest[j], n * n))
        self.rest = np.array([float(Fraction(r, n)) for r in rest])  # mean - centre

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre).astype(np.float64) - self.rest


def exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y in whole numbers: floating point only where every partial sum is exact."""
    most = int(np.abs(y).max(initial=0))
    if most * most > EXACT:
        z = y.astype(object)
        return z.T @ z
    step, total = max(1, EXACT // max(1, most * most)), np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), step):
        z = y[at : at + step].astype(np.float64)
        total = total + (z.T @ z).astype(np.int64).astype(object)
    return total


def exact_sums(x: np.ndarray) -> np.ndarray:
    return (x if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object)).sum(axis=0).astype(object)


def summed(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int) -> dict[int, int]:
    """The sum over all rows of what ``of`` makes of each batch, by place; exact, in two halves that fit longs and decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            made = of(matrix(b.column("x"), width)).ravel()
            total = made if total is None else total + made
        if total is not None:
            halves = [pa.array([int(v) >> 62 for v in total], pa.int64()), pa.array([int(v) & ((1 << 62) - 1) for v in total], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *halves], names=["i", "high", "low"])

    rows = fit.mapInArrow(run, "i int, high long, low long").groupBy("i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    return {r.i: (int(r.high) << 62) + int(r.low) for r in rows.collect()}


def moments(fit: DataFrame, width: int) -> Moments | None:
    """fit: distinct x, all of this width."""
    n = fit.count()
    if not n:
        return None
    found = summed(fit, exact_sums, width)
    sums = [found[i] for i in range(width)]
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    up = np.triu_indices(width)
    products = summed(fit, lambda x: exact_products(x - centre)[up], width)
    return Moments(n, sums, centre, {(int(i), int(j)): products[k] for k, (i, j) in enumerate(zip(*up, strict=True))})


# the spectrum


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a symmetric matrix brought to tridiagonal form by Householder reflections."""
    t = a.copy()
    for k in range(len(t) - 2):
        v = t[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0:
            continue
        v[0] += norm if v[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        t[k + 1 :, k:] -= 2 * np.outer(v, v @ t[k + 1 :, k:])
        t[k:, k + 1 :] -= 2 * np.outer(t[k:, k + 1 :] @ v, v)
    return np.diag(t).copy(), np.diag(t, 1).copy()


def inertia(t: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues are below the shift: negative pivots of T - shift."""
    diagonal, beside = t
    least = np.finfo(float).tiny / np.finfo(float).eps
    count, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - shift - (beside[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < least:
            pivot = -least
        count += pivot < 0
    return count


def position(t: tuple[np.ndarray, np.ndarray], k: int, low: float, high: float, close: float) -> float:
    """The k-th eigenvalue from below (1-based) to within ``close``, by bisection on the inertia."""
    while high - low > close:
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (low, middle) if inertia(t, middle) >= k else (middle, high)
    return (low + high) / 2


def feast(a: np.ndarray, low: float, high: float, count: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of symmetric a between low and high, by falling eigenvalue."""
    d, norm = len(a), np.abs(a).sum(axis=1).max()
    radius, middle = (high - low) / 2, (high + low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    angles = np.pi * (1 + points) / 2  # the upper half circle; the lower is its conjugate
    size = min(d, count + max(2, count // 2))
    while True:
        q = np.random.default_rng(7).standard_normal((d, size))
        for _ in range(ROUNDS):
            image = np.zeros((d, size))
            for angle, weight in zip(angles, weights, strict=True):
                turn = radius * np.exp(1j * angle)
                image += weight / 2 * (turn * np.linalg.solve((middle + turn) * np.eye(d) - a, q.astype(complex))).real
            basis = np.linalg.qr(image)[0]
            ritz, within = np.linalg.eigh(basis.T @ a @ basis)
            q = basis @ within
            inside = np.flatnonzero((ritz > low) & (ritz < high))[::-1]
            residual = np.linalg.norm(a @ q[:, inside] - q[:, inside] * ritz[inside], axis=0)
            if len(inside) == count and (residual <= 16 * d * np.finfo(float).eps * norm).all():
                return ritz[inside], q[:, inside]
        if size == d:
            if len(inside) == count and (residual <= 1e-10 * norm).all():
                return ritz[inside], q[:, inside]
            raise ArithmeticError(f"inertia counts {count} eigenvalues between {low} and {high}; the contour gave {len(inside)}")
        size = min(d, 2 * size)


def leading(a: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``components`` largest eigenvalues of a covariance and their unit eigenvectors as columns."""
    d, wanted = len(a), min(components, len(a))
    scale = np.abs(a).sum(axis=1).max(initial=0)
    if not scale:
        return np.zeros(wanted), np.eye(d)[:, :wanted]
    t, bound = tridiagonal(a / scale), 1.01
    close = 1e-6
    look = min(d, wanted + LOOK)
    at = [position(t, d - k, -bound, bound, close) for k in range(look)]  # the largest first
    after = [*at[1:], -bound] if look == d else at[1:]
    gaps = [at[k] - after[k] for k in range(wanted - 1, len(after))]
    best = wanted - 1 + int(np.argmax(gaps))
    cut = -bound if best + 1 == d else (at[best] + after[best]) / 2
    if gaps[best - wanted + 1] <= 4 * close:  # no gap that can be told: take in everything
        cut = -bound
    count = d - inertia(t, cut)
    values, vectors = feast(a / scale, cut, bound, count)
    return values[:wanted] * scale, vectors[:, :wanted]


# the table again


def projected(m: Moments, values: np.ndarray, vectors: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Rows of x -> rows of whitened numbers; NaN for a component without spread."""
    flat = values <= m.width * np.finfo(float).eps * np.trace(m.covariance)
    scaled = vectors / np.where(flat, np.nan, np.sqrt(np.where(flat, 1, values)))
    return lambda x: m.centred(x) @ scaled


def identity_error(fit: DataFrame, m: Moments, project: Callable[[np.ndarray], np.ndarray]) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    width = m.width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, 0.0, 0.0
        for b in batches:
            w = project(matrix(b.column("x"), width))
            n, s, p = n + len(w), s + w.sum(axis=0), p + w.T @ w
        if n:
            k = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k, dtype=np.int32)), pa.array(np.concatenate((s, p.ravel())))], names=["i", "v"])

    found = sorted((r.i, r.v) for r in fit.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect())
    k = next(k for k in range(COMPONENTS * len(found) + 1) if k + k * k == len(found))
    v = np.array([x for _, x in found]) / m.n
    covariance = v[k:].reshape(k, k) - np.outer(v[:k], v[:k])
    there = ~np.isnan(np.diag(covariance))
    return float(np.abs(covariance - np.eye(k))[np.ix_(there, there)].max()) if there.any() else None


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = finite_rows(vectors)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    fit = durable_table(rows.select(filled.alias("x")).dropDuplicates(["x"]))
    m = moments(fit, width) if width else None
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if m is None:
        return vectors.sparkSession.createDataFrame([], schema)
    values, directions = leading(m.covariance, components)
    project, trace, most = projected(m, values, directions), float(np.trace(m.covariance)), len(values)
    error = identity_error(fit, m, project)
    n, sums = m.n, np.array(m.sums, object)

    def deviations(x: np.ndarray) -> list[int | None]:
        far = n * int(np.abs(x).max(initial=0)) + max(map(abs, m.sums))
        if far * far * width < 1 << 63:
            return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in ((n * x.astype(object) - sums) ** 2).sum(axis=1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), width)
            w = project(x).ravel()
            again = np.repeat(np.arange(len(x)), most)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(again)), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(x))), pa.array(np.full(len(again), n, np.int64)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(again)), pa.array(w, mask=np.isnan(w)),
                    pa.array(np.tile(values / trace if trace else np.zeros(most), len(x)), mask=np.full(len(again), not trace)), pa.array([error] * len(again), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(work, schema)
