"""Linear ranking models of factors on forward returns: pairwise (logistic) and listwise (softmax) losses per date.

Gradients are sums over dates. Each round, every date's gradient is computed where its rows are and only the sum,
one number per factor, comes to the driver; the training table is stored once, dealt by date.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pairwise(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the mean logistic loss over pairs of a date; sorted cumulative sums would need no pairs, a date's codes are few."""
    s = x @ w
    ahead = y[:, None] > y[None, :]
    if not ahead.any():
        return np.zeros_like(w)
    miss = ahead / (1 + np.exp(np.clip(s[:, None] - s[None, :], -50, 50)))
    push = miss.sum(0) - miss.sum(1)
    return x.T @ push / ahead.sum()


def _listwise(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the cross entropy between the softmax of scores and that of standardised returns."""
    s = x @ w
    p = np.exp(s - s.max())
    z = (y - y.mean()) / y.std() if y.std() > 0 else np.zeros_like(y)
    q = np.exp(z - z.max())
    return x.T @ (p / p.sum() - q / q.sum())


def standardised(rows: DataFrame, factors: Sequence[str], target: str | None = None) -> DataFrame:
    """Factors as standard scores per date, missing ones 0."""
    day = Window.partitionBy("date_")

    def z(name: str) -> Column:
        sd = F.stddev_pop(name).over(day)
        return F.coalesce(F.when(sd > 1e-9, (F.col(name) - F.avg(name).over(day)) / sd), F.lit(0.0)).alias(name)

    return rows.select("date_", "code", *map(z, factors), *([target] if target else []))


def fit(rows: DataFrame, factors: Sequence[str], target: str, *, loss: str = "pairwise", rounds: int = 15, rate: float = 0.5, shrink: float = 1e-3) -> dict[str, float]:
    """Weights of the factors by gradient descent; ``rows`` should be a stored table, as every round reads it."""
    gradient = {"pairwise": _pairwise, "listwise": _listwise}[loss]
    names = list(factors)
    table = standardised(rows.where(F.col(target).isNotNull()), names, target)
    w = np.zeros(len(names))
    schema = ", ".join(f"g{i} double" for i in range(len(names))) + ", n double"
    for _ in range(rounds):
        sums = table.groupBy("date_").applyInPandas(_step(gradient, names, target, w), schema).agg(*(F.sum(f"g{i}") for i in range(len(names))), F.sum("n")).first()
        if not sums[len(names)]:
            break
        w = w - rate * (np.array(sums[: len(names)], float) / sums[len(names)] + shrink * w)
    return dict(zip(names, w.tolist(), strict=True))


def _step(gradient, names: list[str], target: str, w: np.ndarray):
    """The gradient of one date's rows at the weights."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        g = gradient(part[names].to_numpy(float), part[target].to_numpy(float), w) if len(part) > 1 else np.zeros(len(w))
        return pd.DataFrame([[*g, 1.0]], columns=[f"g{i}" for i in range(len(w))] + ["n"])

    return run


def predict(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Scores of all rows, a sum of columns."""
    z = standardised(rows, list(weights))
    return z.select("date_", "code", sum((F.col(n) * v for n, v in weights.items()), F.lit(0.0)).alias("score"))


def select(scores: DataFrame, n: int) -> DataFrame:
    """The n best codes of each date; ties go by code."""
    place = F.row_number().over(Window.partitionBy("date_").orderBy(F.round("score", 9).desc(), "code"))
    return scores.withColumn("place", place).where(F.col("place") <= n)


def ic_weights(rows: DataFrame, factors: Sequence[str], target: str) -> dict[str, float]:
    """Weights in proportion to the factors' mean rank correlation with the target."""
    from quantloom.operators.evaluation import corr_of, mean_rank

    by = ("date_",)
    ranked = rows.where(F.col(target).isNotNull()).select("date_", *(mean_rank(F.col(n), by).alias(n) for n in factors), mean_rank(F.col(target), by).alias("__y"))
    daily = ranked.groupBy("date_").agg(*(corr_of(F.col(n), F.col("__y")).alias(n) for n in factors))
    row = daily.agg(*(F.avg(n).alias(n) for n in factors)).first()
    total = sum(abs(row[n] or 0.0) for n in factors) or 1.0
    return {n: (row[n] or 0.0) / total for n in factors}
