"""Tests of many factors: corrected p values, empirical Bayes, recursive estimates, convexity.

What is tested is one row per factor, or one series per group: small tables beside the data they sum up.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_share(tests: DataFrame, p: str = "p", limit: float = 0.5) -> DataFrame:
    """Estimated share of true null hypotheses: p values above a limit, over what would be there if all were null."""
    return tests.where(F.col(p).isNotNull()).agg(F.least(F.avg((F.col(p) > limit).cast("double")) / (1 - limit), F.lit(1.0)).alias("pi0"))


def more_corrections(tests: DataFrame, p: str = "p", limit: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Yekutieli values and Storey's q values, with what each discovers; one row per test."""
    every = Window.partitionBy(F.lit(1))
    rows = tests.where(F.col(p).isNotNull()).select(
        "*", F.count(p).over(every).alias("__n"), F.row_number().over(every.orderBy(p, "name")).alias("__k"), F.least(F.avg((F.col(p) > limit).cast("double")).over(every) / (1 - limit), F.lit(1.0)).alias("__pi0")
    )
    down = every.orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0)
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("__n").cast("int")), F.lit(0.0), lambda a, k: a + 1.0 / k)
    step = F.min(F.col(p) * F.col("__n") / F.col("__k")).over(down)
    out = rows.select(*tests.columns, F.least(step * harmonic, F.lit(1.0)).alias("yekutieli"), F.least(step * F.col("__pi0"), F.lit(1.0)).alias("q"))
    return out.select("*", (F.col("yekutieli") <= alpha).alias("yekutieli_found"), (F.col("q") <= alpha).alias("q_found"))


def mixture(z: np.ndarray, rounds: int = 200, tol: float = 1e-8) -> tuple[float, float, np.ndarray]:
    """Two normal groups around zero, of variance 1 and of a larger one: share of the first, the larger variance, and each value's chance of the first."""
    if not len(z):
        return 1.0, 1.0, np.zeros(0)
    pi0, var = 0.8, max(float(np.mean(z * z)), 1.0) + 1.0
    null = np.full(len(z), pi0)
    normal = lambda v: np.exp(-z * z / (2 * v)) / math.sqrt(2 * math.pi * v)
    for _ in range(rounds):
        a, b = pi0 * normal(1.0), (1 - pi0) * normal(var)
        null = a / np.maximum(a + b, 1e-300)
        new_pi0 = float(np.clip(null.mean(), 1e-6, 1 - 1e-6))
        new_var = max(float(((1 - null) * z * z).sum() / max((1 - null).sum(), 1e-12)), 1.0 + 1e-6)
        moved = abs(new_pi0 - pi0) + abs(new_var - var)
        pi0, var = new_pi0, new_var
        if moved < tol:
            break
    return pi0, var, null


#: Factors that one mixture is fitted on.
MOST = 1_000_000


def bayes_table(tests: DataFrame, z: str = "z", alpha: float = 0.05) -> DataFrame:
    """Per factor the local false discovery rate, posterior mean and deviation of its effect, and whether it is a discovery."""
    rows = tests.where(F.col(z).isNotNull()).select("name", z).orderBy("name").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} factors")
    values = np.array([r[z] for r in rows], float)
    pi0, var, null = mixture(values)
    shrink = max(var - 1.0, 0.0) / var
    mean = (1 - null) * shrink * values
    spread = np.sqrt(np.maximum((1 - null) * (shrink + (shrink * values) ** 2) - mean**2, 0.0))
    out = [(r["name"], float(v), float(n), float(m), float(s), bool(n <= alpha), pi0, var) for r, v, n, m, s in zip(rows, values, null, mean, spread, strict=True)]
    return tests.sparkSession.createDataFrame(out, "name string, z double, local_fdr double, posterior_mean double, posterior_sd double, discovered boolean, pi0 double, alt_variance double")


def hierarchical_table(tests: DataFrame, group: str, z: str = "z", alpha: float = 0.05, strength: float = 5.0) -> DataFrame:
    """As :func:`bayes_table`, with the share of nulls of each group drawn to that of all by a prior of ``strength`` factors."""
    rows = tests.where(F.col(z).isNotNull()).select("name", group, z).orderBy("name").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} factors")
    values, groups = np.array([r[z] for r in rows], float), np.array([str(r[group]) for r in rows])
    pi0, var, null = mixture(values)
    share = {g: (null[groups == g].sum() + strength * pi0) / ((groups == g).sum() + strength) for g in set(groups.tolist())}
    prior = np.array([share[g] for g in groups.tolist()])
    a, b = prior * np.exp(-values**2 / 2), (1 - prior) * np.exp(-values**2 / (2 * var)) / math.sqrt(var)
    null = a / np.maximum(a + b, 1e-300) if len(values) else null
    out = [(r["name"], str(r[group]), float(v), float(p), float(n), bool(n <= alpha)) for r, v, p, n in zip(rows, values, prior, null, strict=True)]
    return tests.sparkSession.createDataFrame(out, f"name string, {group} string, z double, group_pi0 double, local_fdr double, discovered boolean")


def error_rates(table: DataFrame) -> DataFrame:
    """Expected share of false discoveries, and the chance of any, among the discovered."""
    found = table.where("discovered")
    return found.agg(F.count("*").alias("n"), F.avg("local_fdr").alias("fdr"), (1 - F.exp(F.sum(F.log1p(-F.least("local_fdr", F.lit(1 - 1e-12)))))).alias("fwer"))


def rolling_alpha(series: DataFrame, column: str, window: int = 60, least: int = 20, by: str = "name") -> DataFrame:
    """Shrunk mean of the last values: prior around zero of the variance that their spread doesn't explain."""
    w = Window.partitionBy(by).orderBy("date_").rowsBetween(-(window - 1), 0)
    n, mean, var = F.count(column).over(w), F.avg(column).over(w), F.var_samp(column).over(w)
    rows = series.select(by, "date_", n.alias("n"), mean.alias("mean"), (var / n).alias("error"))
    prior = F.greatest(F.col("mean") * F.col("mean") - F.col("error"), F.lit(0.0))
    shrink = F.try_divide(prior, prior + F.col("error"))
    full = F.col("n") >= least
    return rows.select(by, "date_", F.when(full, F.col("mean")).alias("mean"), F.when(full, shrink).alias("shrink"), F.when(full, shrink * F.col("mean")).alias("posterior"), F.when(full, F.sqrt(shrink * F.col("error"))).alias("posterior_sd"))


def local_level(y: np.ndarray, discount: float = 0.98, noise: float | None = None) -> np.ndarray:
    """Kalman filter of a drifting mean: columns prior, posterior, deviation, gain."""
    noise = float(np.var(y)) if noise is None else noise
    noise = max(noise, 1e-12)
    mean, var = 0.0, noise
    out = np.empty((len(y), 4))
    for t, value in enumerate(y):
        spread = var / discount
        gain = spread / (spread + noise)
        prior, mean = mean, mean + gain * (value - mean)
        var = (1 - gain) * spread
        out[t] = prior, mean, math.sqrt(var), gain
    return out


def dynamic_alpha(series: DataFrame, column: str, by: str = "name", discount: float = 0.98, alpha: float = 0.05) -> DataFrame:
    """Recursive estimate of a drifting mean per group; one group's series, a row per date, is one task's."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna(subset=[column]).sort_values("date_")
        table = local_level(part[column].to_numpy(float), discount) if len(part) else np.zeros((0, 4))
        out = part[[by, "date_"]].copy()
        out["prior"], out["posterior"], out["deviation"], out["gain"] = table.T if len(part) else [[]] * 4
        out["positive"] = [0.5 * (1 + math.erf(m / s / math.sqrt(2))) if s > 0 else float(m > 0) for m, s in zip(table[:, 1], table[:, 2], strict=True)]
        out["discovered"] = [2 * min(p, 1 - p) <= alpha for p in out["positive"]]
        return out

    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    schema = f"{by} {kinds[by]}, date_ {kinds['date_']}, prior double, posterior double, deviation double, gain double, positive double, discovered boolean"
    return series.select(by, "date_", column).groupBy(by).applyInPandas(run, schema)


def hacking_update(pairs: DataFrame, inside: str, outside: str, by: str = "name", prior: float = 0.5) -> DataFrame:
    """Belief that a factor is real, updated by each pair of in-sample and out-of-sample estimates.

    A real factor's second estimate lies around the first, a found-by-chance one's around zero; both with the
    spread of the second estimates of its group. The log odds are running sums, so one window does it.
    """
    own = Window.partitionBy(by)
    sd2 = F.greatest(F.var_samp(outside).over(own), F.lit(1e-12))
    a, b = F.col(inside), F.col(outside)
    gain = (b * b - (b - a) * (b - a)) / (2 * sd2)
    so_far = own.orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)
    rows = pairs.where(a.isNotNull() & b.isNotNull()).select(by, "date_", a, b, gain.alias("__g"))
    odds = F.sum("__g").over(so_far) + math.log(prior / (1 - prior))
    return rows.select(by, "date_", inside, outside, (1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-700.0)), F.lit(700.0))))).alias("belief"))


def quadratic(series: DataFrame, y: str, x: str, lags: int = 5) -> DataFrame:
    """Regression of a return on a market and its square, with errors robust to autocorrelation over ``lags`` rows.

    All sums are aggregates over the dates and their lags; the 3 x 3 system is solved in expressions on one row.
    """
    cols = ("1", "x", "q")
    rows = series.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("date_", F.col(y).alias("y"), F.lit(1.0).alias("1"), F.col(x).alias("x"), (F.col(x) * F.col(x)).alias("q"))
    sums = rows.agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(cols) for b in cols[i:]), *(F.sum(F.col(a) * F.col("y")).alias(f"{a}y") for a in cols), F.sum(F.col("y") * F.col("y")).alias("yy")).first()
    n = sums["n"]
    schema = "term string, estimate double, error double, t double, n long, r2 double"
    if n < 5:
        return series.sparkSession.createDataFrame([], schema)
    m = np.array([[sums[f"{a}{b}"] if f"{a}{b}" in sums.asDict() else sums[f"{b}{a}"] for b in cols] for a in cols], float)
    inverse = np.linalg.pinv(m)
    beta = inverse @ np.array([sums[f"{a}y"] for a in cols], float)
    fitted = sum((F.col(c) * float(b) for c, b in zip(cols, beta, strict=True)), F.lit(0.0))
    order = Window.orderBy("date_")  # a row per date
    scores = rows.select("date_", *((F.col(c) * (F.col("y") - fitted)).alias(f"s{c}") for c in cols), (F.col("y") - fitted).alias("e"))
    lagged = scores.select("*", *(F.lag(f"s{c}", k).over(order).alias(f"s{c}_{k}") for c in cols for k in range(1, lags + 1)))
    row = lagged.agg(
        F.sum(F.col("e") * F.col("e")).alias("rss"), *(F.sum(F.col(f"s{a}") * F.col(f"s{b}")).alias(f"{a}{b}_0") for a in cols for b in cols), *(F.sum(F.col(f"s{a}") * F.col(f"s{b}_{k}")).alias(f"{a}{b}_{k}") for a in cols for b in cols for k in range(1, lags + 1))
    ).first()
    part = lambda k: np.array([[row[f"{a}{b}_{k}"] or 0.0 for b in cols] for a in cols], float)
    meat = part(0)
    for k in range(1, lags + 1):
        meat = meat + (1 - k / (lags + 1)) * (part(k) + part(k).T)
    error = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0.0))
    total = sums["yy"] - sums["1y"] ** 2 / n
    out = [(name, float(b), float(e), float(b / e) if e > 0 else None, n, 1 - row["rss"] / total if total > 0 else None) for name, b, e in zip(("alpha", "beta", "gamma"), beta, error, strict=True)]
    return series.sparkSession.createDataFrame(out, schema)


def decay(table: DataFrame, column: str = "mean_ic") -> DataFrame:
    """Line of a coefficient on the horizon, per factor."""
    return table.groupBy("name").agg(F.regr_slope(F.col(column), F.col("horizon").cast("double")).alias("slope"), F.max_by(column, -F.col("horizon")).alias("first"), F.max_by(column, "horizon").alias("last"))


def recent(ic: DataFrame, column: str, window: int = 12) -> DataFrame:
    """Mean and ratio of the last dates beside those before, their gap and quotient."""
    x = F.col(column)
    rows = ic.where(x.isNotNull()).select(x.alias("x"), (F.row_number().over(Window.orderBy(F.desc("date_"))) <= window).alias("new"))  # a row per date
    side = lambda new: F.when(F.col("new") == new, F.col("x"))
    out = rows.agg(F.avg(side(False)).alias("history"), F.avg(side(True)).alias("recent"), F.try_divide(F.avg(side(False)), F.stddev_samp(side(False))).alias("history_ir"), F.try_divide(F.avg(side(True)), F.stddev_samp(side(True))).alias("recent_ir"))
    return out.select("*", (F.col("recent") - F.col("history")).alias("gap"), F.try_divide("recent", "history").alias("quotient"))
