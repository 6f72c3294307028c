"""Ridge-regularised logistic regression by distributed Newton steps, cross-validated in one go.

The loss is the mean logistic loss plus l2 / 2 times the squared weights of the scaled features; the bias is not
penalised. Features are scaled by mean and population deviation of the rows that train. A step is one pass: each task
adds up, for every fold, loss, gradient and Hessian of its rows that train it, as vectors of a fixed size, and only
their sums come to the driver, where systems as wide as the features are solved. A step that raises the loss is halved.
The optimum is unique, so the result is that of any solver run to its end. Training rows of a single class have none:
their bias is LEAST or -LEAST and their weights are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

L2, STEPS, CLOSE, TINY, LEAST = 0.01, 60, 1e-10, 1e-9, 50.0


class Model:
    """mean and deviation of the training rows, and the weights with the bias at the end."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, weights: np.ndarray) -> None:
        self.mean, self.deviation, self.weights = mean, deviation, weights

    def chance(self, features: Column) -> Column:
        """The chance of label 1, as a column expression."""
        scale = self.weights[:-1] / (self.deviation + TINY)
        at = F.array(*(F.lit(float(m)) for m in self.mean))
        by = F.array(*(F.lit(float(s)) for s in scale))
        scaled = F.zip_with(F.zip_with(features, at, lambda x, m: x - m), by, lambda x, s: x * s)
        z = F.aggregate(scaled, F.lit(float(self.weights[-1])), lambda s, x: s + x)
        return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))))


def training_moments(rows: DataFrame, folds: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per fold: number, mean and deviation (with TINY added) of the rows outside it."""
    per = rows.select("fold", F.posexplode("features").alias("i", "x")).groupBy("fold", "i").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance")).collect()
    width = max((r.i for r in per), default=-1) + 1
    n, mean, variance = np.zeros(folds), np.zeros((folds, width)), np.zeros((folds, width))
    for r in per:
        n[r.fold], mean[r.fold, r.i], variance[r.fold, r.i] = r.n, r.mean, r.variance
    out = []
    for k in range(folds):
        others = [j for j in range(folds) if j != k] if folds > 1 else [0]
        total = n[others].sum()
        m = (n[others, None] * mean[others]).sum(axis=0) / max(total, 1)
        v = (n[others, None] * (variance[others] + (mean[others] - m) ** 2)).sum(axis=0) / max(total, 1)
        out.append((int(total), m, np.sqrt(v) + TINY))
    return out


def one_step(rows: DataFrame, moments: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, l2: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Per fold: loss, gradient and Hessian at its weights, from one pass."""
    folds, d = weights.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, 1 + d + d * d))
        for b in batches:
            x = np.asarray(b.column("features").flatten(), float).reshape(b.num_rows, d - 1)
            y, fold = b.column("label").to_numpy(zero_copy_only=False).astype(float), b.column("fold").to_numpy(zero_copy_only=False)
            for k, (_, mean, deviation) in enumerate(moments):
                use = fold != k if folds > 1 else np.ones(len(y), bool)
                z = np.column_stack(((x[use] - mean) / deviation, np.ones(use.sum())))
                t = np.clip(z @ weights[k], -50, 50)
                p = 1 / (1 + np.exp(-t))
                total[k, 0] += (np.logaddexp(0, t) - y[use] * t).sum()
                total[k, 1 : 1 + d] += z.T @ (p - y[use])
                total[k, 1 + d :] += ((z * (p * (1 - p))[:, None]).T @ z).ravel()
        at = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["k", "i", "v"])

    sums = np.zeros((folds, 1 + d + d * d))
    for r in rows.mapInArrow(work, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        sums[r.k, r.i] = r.v
    penalty, out = np.r_[np.full(d - 1, l2), 0.0], []
    for k, (n, _, _) in enumerate(moments):
        s, w = sums[k] / max(n, 1), weights[k]
        out.append((s[0] + 0.5 * (penalty * w * w).sum(), s[1 : 1 + d] + penalty * w, s[1 + d :].reshape(d, d) + np.diag(penalty)))
    return out


def fitted(rows: DataFrame, folds: int = 1, l2: float = L2) -> list[Model]:
    """One model per fold, trained on the rows outside it (with one fold: on all rows).

    rows: features (doubles, of one length), label (0 or 1), fold (0 to folds - 1); read once a step, so best stored.
    """
    rows = rows if folds > 1 else rows.withColumn("fold", F.lit(0))
    moments = training_moments(rows, folds)
    d = len(moments[0][1]) + 1
    weights, step = np.zeros((folds, d)), np.ones(folds)
    classes = {r.fold: (r.least, r.most) for r in rows.groupBy("fold").agg(F.min("label").alias("least"), F.max("label").alias("most")).collect()}
    trains = [[c for j, c in classes.items() if folds == 1 or j != k] for k in range(folds)]
    single = [None if len(x := {v for c in t for v in c}) > 1 else (-LEAST if x in (set(), {0}) else LEAST) for t in trains]
    weights[:, -1] = [b or 0.0 for b in single]
    last, direction = np.full(folds, np.inf), np.zeros((folds, d))
    for _ in range(STEPS):
        done = True
        for k, (loss, gradient, hessian) in enumerate(one_step(rows, moments, weights, l2)):
            if single[k] is not None:
                continue
            if loss > last[k] + 1e-15 * abs(last[k]):  # too far: half the way back
                step[k] /= 2
                weights[k] += step[k] * direction[k]
                done = False
                continue
            last[k], step[k] = loss, 1.0
            if np.abs(gradient).max(initial=0) > CLOSE:
                direction[k] = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
                weights[k] -= direction[k]
                done = False
        if done:
            break
    return [Model(m, s, w) for (_, m, s), w in zip(moments, weights, strict=True)]


def out_of_fold(rows: DataFrame, folds: int, l2: float = L2) -> DataFrame:
    """rows with chance: each by the model that was not trained on its fold."""
    models, chance = fitted(rows.select("features", "label", "fold"), folds, l2), F.lit(None).cast("double")
    for k, m in enumerate(models):
        chance = F.when(F.col("fold") == k, m.chance(F.col("features"))).otherwise(chance)
    return rows.withColumn("chance", chance)
