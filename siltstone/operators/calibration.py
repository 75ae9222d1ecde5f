"""Probabilities of a margin classifier: a logistic curve over out-of-fold margins (Platt scaling)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.values import shuffled_place
from siltstone.operators.tabular import fit_model, predictions

#: Newton steps at most, and the step under which the fit has converged.
STEPS, ENOUGH = 100, 1e-10


@dataclass
class Curve:
    """probability of label 1 = 1 / (1 + exp(slope * margin + shift))."""

    slope: float
    shift: float

    def probability(self, margin: Column) -> Column:
        return 1 / (1 + F.exp(F.lit(self.slope) * margin + F.lit(self.shift)))


def fit_curve(rows: DataFrame, margin: str = "score", label: str = "label", steps: int = STEPS) -> Curve:
    """The curve of largest likelihood over (margin, label 0 or 1), by Newton's method.

    Labels are smoothed to (p + 1) / (p + 2) and 1 / (n + 2), p and n being how many there are, so
    that the fit stays finite where a margin parts the labels. A step is one aggregation of six
    sums; it is halved until the likelihood does not fall. Rows with a null take no part; of no
    rows at all the curve is flat at one half.
    """
    known = rows.where(F.col(margin).isNotNull() & F.col(label).isNotNull())
    # a row for each margin and label
    held = known.groupBy(F.col(margin).cast("double").alias("m"), F.col(label).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        p, n = (x or 0 for x in held.agg(F.sum(F.when(F.col("y") > 0, F.col("n"))), F.sum(F.when(F.col("y") <= 0, F.col("n")))).first())
        target = F.when(F.col("y") > 0, (p + 1) / (p + 2)).otherwise(1 / (n + 2))

        def sums(a: float, b: float) -> np.ndarray:
            """Loss, two parts of the gradient, three of the Hessian."""
            z = F.lit(a) * F.col("m") + F.lit(b)
            q = 1 / (1 + F.exp(z))
            # log(1 + exp(z)) without overflow
            loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - (1 - target) * z
            off, w = target - q, q * (1 - q)
            each = [loss, off * F.col("m"), off, w * F.col("m") * F.col("m"), w * F.col("m"), w]
            return np.array([x or 0.0 for x in held.agg(*[F.sum(F.col("n") * x).alias(f"s{i}") for i, x in enumerate(each)]).first()])

        a, b = 0.0, float(np.log((n + 1) / (p + 1)))
        now = sums(a, b)
        for _ in range(steps if p + n else 0):
            hessian = np.array([[now[3] + 1e-12, now[4]], [now[4], now[5] + 1e-12]])
            da, db = -np.linalg.solve(hessian, now[1:3])
            size = 1.0
            while size > 1e-10:
                new = sums(a + size * da, b + size * db)
                if new[0] <= now[0] + 1e-12 * abs(now[0]):
                    break
                size /= 2
            a, b, now = a + size * da, b + size * db, new
            if max(abs(size * da), abs(size * db)) < ENOUGH * (1 + max(abs(a), abs(b))):
                break
        return Curve(float(a), float(b))
    finally:
        held.unpersist()


def out_of_fold(kind: str, train: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(key, label, prediction, score) of every row by a model that was fitted without its fold."""
    fold = shuffled_place(F.col(key), 8, seed) % folds
    out = None
    for i in range(folds):
        model = fit_model(kind, train.where(fold != i), seed)
        part = predictions(model, train.where(fold == i), key)
        out = part if out is None else out.unionByName(part)
    return out


def fit_calibrated(kind: str, train: DataFrame, key: str, folds: int = 5, seed: int = 42) -> tuple[Model, Curve]:
    """The model of all rows, and the curve of the margins that models without a row's fold give it."""
    return fit_model(kind, train, seed), fit_curve(out_of_fold(kind, train, key, folds, seed))


def calibrated_predictions(model: Model, curve: Curve, rows: DataFrame, key: str) -> DataFrame:
    """predictions() with `probability` of label 1; `prediction` stays the model's own."""
    return predictions(model, rows, key).withColumn("probability", curve.probability(F.col("score")))
