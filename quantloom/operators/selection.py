"""Choosing factors: correlations of their coefficients, groups of like ones, greedy and independent choices.

Correlations are computed in one distributed aggregation. The matrix of k x k factors is small (hundreds)
and the choice from it is a loop on the driver; :data:`MOST` bounds it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.evaluation import corr_of, information_coefficient

#: Factors that one choice may be made from.
MOST = 5000

Matrix = dict[tuple[str, str], float]


def ic_series(data: DataFrame, returns: str) -> DataFrame:
    """Rank correlation with the forward return per factor and date, from a long frame."""
    return information_coefficient(data, "factor", [returns], by=("name", "date_")).withColumnRenamed(f"ic_{returns}", "ic")


def ic_correlations(ic: DataFrame, names: Sequence[str], column: str = "ic") -> DataFrame:
    """Correlation of every two factors' series: dates become rows, factors columns, pairs one aggregation."""
    wide = ic.groupBy("date_").pivot("name", list(names)).agg(F.first(column))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = wide.agg(*(corr_of(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs))).alias("r")).select("r.*")


def matrix(correlations: DataFrame) -> Matrix:
    """The pairs on the driver."""
    rows = correlations.limit(MOST * MOST + 1).collect()
    if len(rows) > MOST * MOST // 2:
        raise ValueError(f"more than {MOST} factors")
    return {(r["a"], r["b"]): r["corr"] for r in rows if r["corr"] is not None}


def between(m: Matrix, a: str, b: str) -> float:
    return 1.0 if a == b else m.get((a, b), m.get((b, a), 0.0))


def greedy(scores: dict[str, float], m: Matrix, limit: float = 0.75) -> list[str]:
    """Best score first, none that correlates with a chosen one by ``limit`` or more."""
    chosen: list[str] = []
    for name in sorted(scores, key=lambda n: (-scores[n], n)):
        if all(abs(between(m, name, c)) < limit for c in chosen):
            chosen.append(name)
    return chosen


def by_average(scores: dict[str, float], m: Matrix, limit: float = 0.75) -> list[str]:
    """Best score first, none whose mean correlation with the chosen ones is above ``limit``."""
    chosen: list[str] = []
    for name in sorted(scores, key=lambda n: (-scores[n], n)):
        if not chosen or sum(abs(between(m, name, c)) for c in chosen) / len(chosen) <= limit:
            chosen.append(name)
    return chosen


def independent(scores: dict[str, float], m: Matrix, limit: float = 0.75) -> list[str]:
    """An independent set of the graph of like factors: score over one more than the neighbours decides."""
    near = {n: {k for k in scores if k != n and abs(between(m, n, k)) >= limit} for n in scores}
    left, chosen = set(scores), []
    while left:
        best = max(left, key=lambda n: (scores[n] / (1 + len(near[n])), scores[n], n))
        chosen.append(best)
        left -= near[best] | {best}
    return chosen


def clusters(names: Sequence[str], m: Matrix, limit: float = 0.7) -> dict[str, int]:
    """Groups by average linkage on 1 - correlation, merged up to a distance of ``limit``; numbered from 1 by first member."""
    names = list(names)
    d = np.array([[1.0 - between(m, a, b) for b in names] for a in names])
    groups = [[i] for i in range(len(names))]
    np.fill_diagonal(d, np.inf)
    sizes = np.ones(len(names))
    while len(groups) > 1:
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        if d[i, j] > limit:
            break
        joint = (d[i] * sizes[i] + d[j] * sizes[j]) / (sizes[i] + sizes[j])
        d[i], d[:, i] = joint, joint
        d[i, i] = np.inf
        sizes[i] += sizes[j]
        groups[i] += groups.pop(j)
        d, sizes = np.delete(np.delete(d, j, 0), j, 1), np.delete(sizes, j)
    order = sorted(groups, key=min)
    return {names[k]: n for n, group in enumerate(order, 1) for k in group}


def representatives(scores: dict[str, float], m: Matrix, limit: float = 0.7) -> list[str]:
    """The best factor of each group, best group first."""
    best: dict[int, str] = {}
    for name, group in clusters(list(scores), m, limit).items():
        if group not in best or scores[name] > scores[best[group]]:
            best[group] = name
    return sorted(best.values(), key=lambda n: (-scores[n], n))


def return_stats(returns: DataFrame, periods: int = 252) -> DataFrame:
    """Yearly growth, risk, ratio and win rate of every series ``(name, date_, ret)``."""
    x = F.col("ret")
    root = float(periods) ** 0.5
    return returns.where(x.isNotNull()).groupBy("name").agg((F.avg(x) * periods).alias("growth"), (F.stddev_pop(x) * root).alias("risk"), (F.try_divide(F.avg(x), F.stddev_pop(x)) * root).alias("sharpe"), F.avg((x > 0).cast("double")).alias("win_rate"), F.count(x).alias("n"))


def objective(mean: float, deviation: float, periods: int = 252, risk: float = 0.5) -> float:
    """Ratio of growth to risk, less a part of the risk."""
    return (mean / deviation * periods**0.5 if deviation > 1e-12 else 0.0) - risk * deviation * periods**0.5


def by_gain(returns: DataFrame, names: Sequence[str], least: float = 0.01, most: int = 10) -> list[tuple[str, float]]:
    """Forward choice: the factor whose equal-weight addition raises the objective most, while it does by ``least``.

    Means and covariances of the k series come from one aggregation; the loop works on that matrix alone.
    """
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} factors")
    wide = returns.groupBy("date_").pivot("name", list(names)).agg(F.first("ret")).fillna(0.0)
    cov = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = wide.agg(*(F.avg(f"`{n}`").alias(f"m|{n}") for n in names), *(F.covar_pop(f"`{a}`", f"`{b}`").alias(f"{a}|{b}") for a, b in cov)).first()
    mean = np.array([row[f"m|{n}"] or 0.0 for n in names])
    c = np.zeros((len(names), len(names)))
    for a, b in cov:
        i, j = names.index(a), names.index(b)
        c[i, j] = c[j, i] = row[f"{a}|{b}"] or 0.0
    chosen: list[int] = []
    out: list[tuple[str, float]] = []
    now = -np.inf
    while len(chosen) < min(most, len(names)):
        tried = [(objective(mean[s].mean(), max(c[np.ix_(s, s)].mean(), 0.0) ** 0.5), -k) for k in range(len(names)) if k not in chosen for s in ([*chosen, k],)]
        value, k = max(tried)
        if value - now < least and chosen:
            break
        chosen.append(-k)
        out.append((names[-k], value))
        now = value
    return out


def registry(cards: Sequence[DataFrame]) -> DataFrame:
    """Scorecards of several runs, one row per factor: that of the best absolute fitness."""
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cards)
    rest = [c for c in every.columns if c != "name"]
    return every.groupBy("name").agg(F.max_by(F.struct(*rest), F.abs("fitness")).alias("r")).select("name", "r.*")


def registry_from(spark, root: str) -> DataFrame:
    """The registry of all scorecards stored below a folder."""
    return registry([spark.read.option("recursiveFileLookup", "true").parquet(root)])
