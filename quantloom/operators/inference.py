"""Screening and inference over factors: tests, corrected p values, selection, states, entropy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rational approximation of the error function, absolute error below 1.5e-7 (fixed values: Abramowitz and Stegun 7.1.26).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def normal_p(t):
    """Two-sided p value of a normal statistic."""
    x = F.abs(t) / F.lit(2.0**0.5)
    k = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * k
    return poly * F.exp(-x * x)


def normal_cdf(z):
    """Share of a standard normal distribution below z, by the same approximation."""
    half = normal_p(z) / 2
    return F.when(z >= 0, 1 - half).otherwise(half)


def corrections(tests: DataFrame, p: str = "p") -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg values of p; one row per test, which are few."""
    n = F.count(p).over(Window.partitionBy())
    by_p = Window.orderBy(p, "name")
    k = F.row_number().over(by_p)
    ranked = tests.select("*", n.alias("__n"), k.alias("__k"))
    up = Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0)
    one = F.lit(1.0)
    return ranked.select(
        *tests.columns,
        F.least(F.col(p) * F.col("__n"), one).alias("bonferroni"),
        F.least(F.max(F.col(p) * (F.col("__n") - F.col("__k") + 1)).over(up), one).alias("holm"),
        F.least(F.min(F.col(p) * F.col("__n") / F.col("__k")).over(down), one).alias("fdr"),
    )


def entropy(df: DataFrame, group: str, topic: str, weight: str | None = None) -> DataFrame:
    """Shannon entropy of a group's topics, and its share of the largest possible."""
    w = F.sum(weight) if weight else F.count("*").cast("double")
    counts = df.groupBy(group, topic).agg(w.alias("w")).where("w > 0")
    total = counts.groupBy(group).agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.log("w")).alias("wlogw"), F.count("*").alias("k"))
    h = F.log("total") - F.col("wlogw") / F.col("total")
    return total.select(group, h.alias("entropy"), F.when(F.col("k") > 1, h / F.log(F.col("k").cast("double"))).otherwise(0.0).alias("normalized"), F.col("k").alias("topics"))


def market_states(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    state = F.when(F.col(column) < low, "bear").when(F.col(column) > high, "bull").when(F.col(column).isNotNull(), "flat")
    return df.withColumn("state", state)


def transitions(states: DataFrame) -> DataFrame:
    """How often one state follows another in a code, and the share of the first's followers."""
    w = Window.partitionBy("code").orderBy("date_")
    pairs = states.where("state is not null").select(F.lag("state").over(w).alias("before"), "state").where("before is not null")
    counts = pairs.groupBy("before", "state").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def stability(ic: DataFrame, column: str) -> DataFrame:
    """Mean and sign of a coefficient in each year, and whether the sign is that of all years."""
    years = ic.groupBy(F.year("date_").alias("year")).agg(F.avg(column).alias("mean"), F.count(column).alias("n"))
    whole = ic.agg(F.avg(column).alias("whole"))
    return years.join(F.broadcast(whole)).select("year", "mean", "n", (F.signum("mean") == F.signum("whole")).cast("int").alias("agrees"))  # one row


def correlations(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every two factors over all rows that have both: one aggregation."""
    from quantloom.operators.evaluation import corr_of

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = panel.agg(*(corr_of(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs)))
    return wide.select(rows.alias("r")).select("r.*")


def select_independent(scores: list[tuple[str, float]], correlation: dict[tuple[str, str], float], limit: float) -> list[str]:
    """Greedy choice: best score first, none that correlates with a chosen one by ``limit`` or more."""
    chosen: list[str] = []
    for name, _ in sorted(scores, key=lambda s: (-s[1], s[0])):
        if all(abs(correlation.get((name, c), correlation.get((c, name), 0.0)) or 0.0) < limit for c in chosen):
            chosen.append(name)
    return chosen


def bootstrap_interval(values: list[float], times: int = 1000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of the mean of a short series, as of coefficients per date."""
    x = np.array([v for v in values if v is not None], float)
    means = np.random.default_rng(seed).choice(x, (times, len(x))).mean(axis=1)
    low, high = np.quantile(means, [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)


def permutation_p(values: list[float], times: int = 1000, seed: int = 0) -> float:
    """Two-sided p value of a mean against zero, by random signs."""
    x = np.array([v for v in values if v is not None], float)
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (times, len(x)))
    return float((np.abs((signs * x).mean(axis=1)) >= abs(x.mean()) - 1e-12).sum() + 1) / (times + 1)


def validated(series: DataFrame, column: str, times: int = 1000, alpha: float = 0.05, seed: int = 0, by: str = "name") -> DataFrame:
    """Mean of every group's series with its bootstrap interval, sign-flip p value, and the means of both halves.

    A series has a row per date; groups spread over tasks, each seeded by its name.
    """
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.dropna(subset=[column]).sort_values("date_")[column].tolist()
        own = int.from_bytes(str(part[by].iloc[0]).encode()[:7], "little") + seed
        low, high = bootstrap_interval(x, times, alpha, own) if x else (None, None)
        half = len(x) // 2
        mean = lambda v: float(np.mean(v)) if v else None
        row = {by: part[by].iloc[0], "n": len(x), "mean": mean(x), "low": low, "high": high, "p": permutation_p(x, times, own) if x else None, "first": mean(x[:half]), "second": mean(x[half:])}
        return pd.DataFrame([row])

    schema = f"{by} {series.schema[by].dataType.simpleString()}, n long, mean double, low double, high double, p double, first double, second double"
    return series.select(by, "date_", column).groupBy(by).applyInPandas(run, schema)


def split_means(ic: DataFrame, column: str) -> DataFrame:
    """Means of the first and the second half of the dates; one row per date goes through one task."""
    w = Window.orderBy("date_")
    rows = ic.where(F.col(column).isNotNull()).select(column, F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    half = F.col("i") <= F.floor(F.col("n") / 2)
    return rows.agg(F.avg(F.when(half, F.col(column))).alias("first"), F.avg(F.when(~half, F.col(column))).alias("second"))
