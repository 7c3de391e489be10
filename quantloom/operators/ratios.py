"""More analytics of return series per group: risk-adjusted and probabilistic ratios, resampling, outliers, simulation.

Rows without a return, or with one of -1 or less, are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.analytics import Z95, autocorrelation_penalty, kurtosis, skewness
from quantloom.operators.inference import normal_cdf


def _walked(returns: DataFrame, column: str, by: str) -> DataFrame:
    """Rows with ``__dd``, the distance from the peak of wealth, and the normal 5 % points of returns and distances."""
    x = F.col(column)
    so_far = Window.partitionBy(by).orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    out = returns.where(x > -1).withColumn("__wealth", F.exp(F.sum(F.log1p(x)).over(so_far)))
    out = out.withColumn("__dd", F.col("__wealth") / F.greatest(F.max("__wealth").over(so_far), F.lit(1.0)) - 1)
    point = lambda c: F.avg(c).over(whole) - Z95 * F.stddev_samp(c).over(whole)
    return out.select("*", point(column).alias("__low"), point("__dd").alias("__dd_low"))


def probable(ratio: Column, skew: Column, kurt: Column, n: Column) -> Column:
    """Probability that a ratio is above zero, given the moments of its returns; null where their spread is none."""
    spread = 1 - skew * ratio + (kurt - 1) / 4 * ratio * ratio
    return F.when((spread > 0) & (n > 1), normal_cdf(ratio * F.sqrt(n - 1) / F.sqrt(spread)))


def ratios(returns: DataFrame, column: str, by: str = "code", periods: int = 252) -> DataFrame:
    """Ratios of growth to risk, smart (autocorrelation-adjusted) and probabilistic ones included: one row per group."""
    x, dd, root = F.col(column), F.col("__dd"), float(periods) ** 0.5
    rows = _walked(returns, column, by)
    n, mean, std = F.count(x), F.avg(x), F.stddev_samp(x)
    whole = rows.groupBy(by).agg(
        n.alias("n"),
        (F.exp(F.sum(F.log1p(x))) - 1).alias("comp"),
        F.avg(F.when(x != 0, x)).alias("avg_return"),
        (F.exp(F.avg(F.log1p(x))) - 1).alias("expected_return"),
        F.stddev_samp(F.log1p(x)).alias("implied_volatility"),
        F.avg((x > 0).cast("double")).alias("rate"),
        F.avg((x != 0).cast("double")).alias("exposed"),
        F.coalesce(F.avg(F.when(x < F.col("__low"), x)), F.first("__low")).alias("cvar"),
        F.coalesce(F.avg(F.when(dd < F.col("__dd_low"), dd)), F.first("__dd_low")).alias("dd_cvar"),
        F.sqrt(F.try_divide(F.sum(dd * dd), n - 1)).alias("ulcer_index"),
        F.abs(F.try_divide(F.avg(F.when(x >= 0, x)), F.count(F.when(x >= 0, x)))).alias("gain"),
        F.abs(F.try_divide(F.avg(F.when(x < 0, x)), F.count(F.when(x < 0, x)))).alias("loss"),
        (F.try_divide(mean, F.stddev_pop(x)) * root).alias("sharpe"),
        (F.try_divide(mean, F.sqrt(F.sum(F.when(x < 0, x * x).otherwise(0.0)) / n)) * root).alias("sortino"),
        F.sum(x).alias("__sum"),
        std.alias("__std"),
        skewness(x).alias("__skew"),
        kurtosis(x).alias("__kurt"),
    )
    c = F.col
    cagr = F.pow(1 + c("comp"), F.lit(float(periods)) / c("n")) - 1
    smart = whole.join(autocorrelation_penalty(returns.where(x > -1), column, by), by, "left")
    smart = smart.withColumns({"smart_sharpe": F.try_divide("sharpe", "penalty"), "smart_sortino": F.try_divide("sortino", "penalty")})
    chance = lambda name: probable(c(name), c("__skew"), c("__kurt"), c("n")).alias(f"probabilistic_{name}")
    return smart.select(
        by, "comp", "avg_return", "expected_return", "implied_volatility", "cvar", "ulcer_index", "smart_sharpe", "smart_sortino",
        F.pow((1 - c("rate")) / (1 + c("rate")), c("n")).alias("risk_of_ruin"),
        F.try_divide(cagr, c("exposed")).alias("rar"),
        F.try_divide(c("comp"), c("ulcer_index")).alias("ulcer_performance"),
        F.try_divide(c("__sum"), c("ulcer_index") * F.try_divide(-c("dd_cvar"), c("__std"))).alias("serenity_index"),
        F.try_divide(c("gain"), c("loss")).alias("profit_ratio"),
        chance("sharpe"), chance("sortino"), chance("smart_sortino"),
    )


def compounded(returns: DataFrame, column: str, by: str = "code") -> DataFrame:
    """Compounded return up to every row."""
    so_far = Window.partitionBy(by).orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)
    return returns.where(F.col(column) > -1).select(by, "date_", (F.exp(F.sum(F.log1p(column)).over(so_far)) - 1).alias("compounded"))


def resample(returns: DataFrame, column: str, unit: str, by: str = "code") -> DataFrame:
    """Compounded return, sum, best and worst of each week, month, quarter or year."""
    x = F.when(F.col(column) > -1, F.col(column))
    return returns.groupBy(by, F.date_trunc(unit, "date_").cast("date").alias("start")).agg(
        (F.exp(F.sum(F.log1p(x))) - 1).alias("compounded"), F.sum(x).alias("total"), F.max(x).alias("best"), F.min(x).alias("worst"), F.count(x).alias("n")
    )


def outliers(returns: DataFrame, column: str, quantile: float = 0.95, *, inside: bool = False, by: str = "code") -> DataFrame:
    """Rows above a quantile of their group; with ``inside`` those below it."""
    x = F.col(column)
    point = F.percentile(x, F.lit(quantile)).over(Window.partitionBy(by))
    rows = returns.where(x.isNotNull()).withColumn("__q", point)
    return rows.where(x < F.col("__q") if inside else x > F.col("__q")).drop("__q")


def histogram(returns: DataFrame, column: str, bins: int = 20, by: str = "code") -> DataFrame:
    """Rows in each of so many bins of equal width between a group's least and largest value; a value on an edge goes up."""
    x, w = F.col(column), Window.partitionBy(by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    place = F.least(F.floor(F.round((x - low) / (high - low) * bins, 9)), F.lit(bins - 1)).cast("int")
    return returns.where(x.isNotNull()).select(by, F.when(high > low, place).otherwise(0).alias("bin")).groupBy(by, "bin").agg(F.count("*").alias("n"))


def compare(returns: DataFrame, column: str, benchmark: str, unit: str = "month", by: str = "code") -> DataFrame:
    """Compounded returns beside a benchmark's per period, their ratio, and whether the benchmark was reached."""
    growth = lambda c: F.exp(F.sum(F.log1p(F.when(F.col(c) > -1, F.col(c))))) - 1
    rows = returns.groupBy(by, F.date_trunc(unit, "date_").cast("date").alias("start")).agg(growth(column).alias("returns"), growth(benchmark).alias("benchmark"))
    return rows.select("*", F.try_divide("returns", "benchmark").alias("multiplier"), (F.col("returns") >= F.col("benchmark")).cast("int").alias("won"))


def rolling_greeks(returns: DataFrame, column: str, benchmark: str, n: int, by: str = "code", periods: int = 252) -> DataFrame:
    """Beta and yearly alpha to a benchmark over the last n rows; null until n rows have both."""
    w = Window.partitionBy(by).orderBy("date_").rowsBetween(-(n - 1), 0)
    x, y = F.when(F.col(column).isNotNull(), F.col(benchmark)), F.when(F.col(benchmark).isNotNull(), F.col(column))
    rows = returns.select(by, "date_", x.alias("__x"), y.alias("__y"))
    var = F.var_samp("__x").over(w)
    rows = rows.select("*", F.when((F.count("__x").over(w) >= n) & (var > 1e-12), F.covar_samp("__y", "__x").over(w) / var).alias("beta"))
    return rows.select(by, "date_", "beta", ((F.avg("__y").over(w) - F.col("beta") * F.avg("__x").over(w)) * periods).alias("alpha"))


def monte_carlo(returns: DataFrame, column: str, sims: int = 1000, seed: int = 0, by: str = "code", periods: int = 252, bust: float = -0.2) -> DataFrame:
    """Random orders of each group's returns: spread of the deepest fall, share below ``bust``, and of resampled growth and Sharpe ratio.

    A group's series goes through one task, ``STEP`` simulations at a time; groups spread over tasks. The
    generator is seeded by the seed and the group's name, so results don't depend on the partitioning.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("date_")[column].to_numpy(float)
        x = x[np.isfinite(x) & (x > -1)]
        name = str(part[by].iloc[0])
        rng = np.random.default_rng([seed, *name.encode()])
        falls, grown, sharpe = [], [], []
        for at in range(0, sims if len(x) else 0, STEP):
            k = min(STEP, sims - at)
            wealth = np.cumprod(1 + rng.permuted(np.tile(x, (k, 1)), axis=1), axis=1)
            falls.append((wealth / np.maximum(np.maximum.accumulate(wealth, axis=1), 1.0) - 1).min(axis=1))
            drawn = rng.choice(x, (k, len(x)))
            grown.append(np.exp(np.log1p(drawn).sum(axis=1) * periods / len(x)) - 1)
            sharpe.append(drawn.mean(axis=1) / np.maximum(drawn.std(axis=1), 1e-12) * periods**0.5)
        row = {by: part[by].iloc[0], "sims": sims if falls else 0}
        for label, values in (("drawdown", falls), ("cagr", grown), ("sharpe", sharpe)):
            v = np.concatenate(values) if values else np.zeros(0)
            for q in (5, 50, 95):
                row[f"{label}_{q}"] = float(np.percentile(v, q)) if len(v) else None
        row["bust"] = float((np.concatenate(falls) <= bust).mean()) if falls else None
        return pd.DataFrame([row])

    names = [f"{label}_{q} double" for label in ("drawdown", "cagr", "sharpe") for q in (5, 50, 95)]
    schema = ", ".join([f"{by} {returns.schema[by].dataType.simpleString()}", "sims long", *names, "bust double"])
    return returns.select(by, "date_", column).groupBy(by).applyInPandas(run, schema)


#: Simulations held at once.
STEP = 50
