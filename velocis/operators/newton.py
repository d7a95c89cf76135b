"""Logistic regression by Newton's method (M5): iteratively reweighted least
squares on distributed sums.

Every round is one pass: each task reduces its rows to the weighted sums
``X'WX`` and ``X'(p - y)`` (matrix products over Arrow batches, one row of
``d + d^2`` numbers a task), the sums are added by Spark, and the driver solves a
system of ``d = features + 1`` unknowns. The objective is that of ``train_lr``:
balanced class weights, features standardised by population mean and deviation,
an L2 penalty ``1 / C`` on all but the intercept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velocis.operators.training import class_weights, fit_scaler
from velocis.schemas import DEFAULT, WindowSet
from velocis.session import ship_code


@dataclass(frozen=True)
class NewtonModel:
    """Coefficients of the standardised features; ``scaler`` holds their means and scales."""
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    scaler: dict
    penalty: float
    rounds: int

    def margin(self) -> F.Column:
        out = F.lit(self.intercept)
        for c, b in zip(self.features, self.coefficients):
            out = out + F.lit(b) * self.scaled(c)
        return out

    def scaled(self, c: str) -> F.Column:
        return (F.col(c) - F.lit(self.scaler[f"mean__{c}"])) / F.lit(self.scaler[f"scale__{c}"])

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``score``, the probability of the positive class."""
        return df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin())))


def _sums(weighted: DataFrame, features: list[str], scaler: dict, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted loss at ``beta`` (intercept last)."""
    mean = np.array([scaler[f"mean__{c}"] for c in features])
    scale = np.array([scaler[f"scale__{c}"] for c in features])
    d = len(features) + 1

    def reduce(batches):
        import numpy as np
        import pyarrow as pa
        g, h = np.zeros(d), np.zeros((d, d))
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in features]).astype(float)
            x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
            w, y = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("weight", "label"))
            m = x @ beta
            p = np.where(m >= 0, 1 / (1 + np.exp(-np.abs(m))), 1 - 1 / (1 + np.exp(-np.abs(m))))
            g += x.T @ (w * (p - y))
            h += (x * (w * p * (1 - p))[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d + d * d), pa.int32()), pa.array(np.r_[g, h.ravel()])],
                                         names=["at", "v"])

    part = weighted.select(*features, "weight", "label").mapInArrow(reduce, "at int, v double")
    total = np.zeros(d + d * d)
    for r in part.groupBy("at").agg(F.sum("v").alias("v")).collect():  # d + d^2 rows
        total[r["at"]] = r["v"]
    return total[:d], total[d:].reshape(d, d)


def train_lr_newton(train: DataFrame, windows: WindowSet = DEFAULT, c: float = 1.0, max_rounds: int = 50,
                    tolerance: float = 1e-8) -> NewtonModel:
    """Fit until the largest step falls below ``tolerance``.

    Rows with a null feature or label are left out. One class alone, or an
    empty table, is an error: the intercept has no finite optimum there.
    """
    ship_code(train.sparkSession)
    features = windows.feature_columns()
    train = train.dropna(subset=[*features, "label"])
    seen = {r["label"] for r in train.groupBy("label").count().collect()}  # two rows
    if seen != {0, 1}:
        raise ValueError(f"labels 0 and 1 are both needed, found {sorted(seen)}")
    scaler = fit_scaler(train, features).first().asDict()
    weighted = class_weights(train, "balanced").select(*features, "label", "weight").checkpoint(eager=True)
    ridge = np.diag([1.0 / c] * len(features) + [0.0])
    beta = np.zeros(len(features) + 1)

    def objective_gradient(b):
        g, h = _sums(weighted, features, scaler, b)
        return g + ridge @ b, h + ridge

    g, h = objective_gradient(beta)
    rounds = 0
    for rounds in range(1, max_rounds + 1):
        step = np.linalg.lstsq(h, g, rcond=None)[0]  # least squares: a constant feature has a zero row but the penalty
        new = beta - step
        g_new, h_new = objective_gradient(new)
        while np.linalg.norm(g_new) > 2 * np.linalg.norm(g) and np.abs(step).max() > tolerance:
            step = step / 2  # a full step overshoots far from the optimum
            new = beta - step
            g_new, h_new = objective_gradient(new)
        beta, g, h = new, g_new, h_new
        if np.abs(step).max() < tolerance:
            break
    return NewtonModel(tuple(features), tuple(map(float, beta[:-1])), float(beta[-1]), scaler, 1.0 / c, rounds)


def lr_gradient(train: DataFrame, model: NewtonModel) -> DataFrame:
    """``feature, gradient`` of the penalised objective at the model's
    coefficients per unit of weight, from plain aggregates; zeros at an optimum."""
    scored = model.transform(class_weights(train, "balanced"))
    miss = F.col("weight") * (F.col("score") - F.col("label"))
    sums = [F.sum(miss * model.scaled(c)) + F.lit(model.penalty * b)
            for c, b in zip(model.features, model.coefficients)] + [F.sum(miss)]
    names = [*model.features, "(intercept)"]
    row = scored.agg(F.sum("weight").alias("_w"), *[s.alias(n) for s, n in zip(sums, names)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), (F.col(f"`{n}`") / F.col("_w")).alias("gradient"))
                                         for n in names])))
