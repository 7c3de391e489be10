"""Analytics of return series per group: tails, ratios, streaks, drawdown spells, benchmarks.

Rows without a return are left out; a return of -1 or less ends wealth and is left out too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One-sided 95 % point of the standard normal distribution (fixed value).
Z95 = 1.6448536269514722


def skewness(x: Column) -> Column:
    """Bias-corrected, null below three values."""
    n = F.count(x)
    return F.when((n > 2) & (F.var_pop(x) > 1e-12), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column) -> Column:
    """Bias-corrected excess, null below four values."""
    n = F.count(x)
    return F.when((n > 3) & (F.var_pop(x) > 1e-12), (F.kurtosis(x) * (n + 1) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def tear_sheet(returns: DataFrame, column: str, by: str = "code", periods: int = 252) -> DataFrame:
    """Tails, win and loss statistics, and ratios, in one aggregation over rows with their wealth and drawdown."""
    x = F.col(column)
    rows = returns.where(x > -1)
    w = Window.partitionBy(by).orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__wealth", F.exp(F.sum(F.log1p(x)).over(w)))
    rows = rows.withColumn("__dd", F.col("__wealth") / F.greatest(F.max("__wealth").over(w), F.lit(1.0)) - 1)
    rows = rows.withColumn("__var", F.percentile(x, 0.05).over(Window.partitionBy(by)))
    n, mean, std = F.count(x), F.avg(x), F.stddev_samp(x)
    win, loss = F.avg(F.when(x > 0, x)), -F.avg(F.when(x < 0, x))
    gains, losses = F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x))
    rate = F.avg((x > 0).cast("double"))
    payoff, factor = F.try_divide(win, loss), F.try_divide(gains, losses)
    tail = F.abs(F.try_divide(F.percentile(x, 0.95), F.percentile(x, 0.05)))
    total = F.exp(F.sum(F.log1p(x))) - 1
    cagr = F.pow(1 + total, F.lit(float(periods)) / n) - 1
    deepest = F.min("__dd")
    ulcer = F.sqrt(F.try_divide(F.sum(F.col("__dd") * F.col("__dd")), n - 1))
    return rows.groupBy(by).agg(
        n.alias("n"),
        (F.exp(F.avg(F.log1p(x))) - 1).alias("geometric_mean"),
        F.avg((x != 0).cast("double")).alias("exposure"),
        win.alias("avg_win"),
        (-loss).alias("avg_loss"),
        rate.alias("win_rate"),
        tail.alias("tail_ratio"),
        factor.alias("omega"),
        F.try_divide(F.sum(x), losses).alias("gain_to_pain"),
        (factor * tail).alias("common_sense"),
        (factor * rate * payoff).alias("cpc_index"),
        F.try_divide(payoff * rate - (1 - rate), payoff).alias("kelly"),
        (mean - Z95 * std).alias("value_at_risk"),
        F.avg(F.when(x <= F.col("__var"), x)).alias("shortfall"),
        skewness(x).alias("skew"),
        kurtosis(x).alias("kurtosis"),
        F.try_divide(F.percentile(x, 0.99), F.avg(F.when(x >= 0, x))).alias("outlier_win"),
        F.try_divide(F.percentile(x, 0.01), F.avg(F.when(x < 0, x))).alias("outlier_loss"),
        deepest.alias("max_drawdown"),
        F.try_divide(cagr, F.abs(deepest)).alias("calmar"),
        F.try_divide(F.sum(x), F.abs(deepest)).alias("recovery"),
        ulcer.alias("ulcer"),
        F.try_divide(mean, std).alias("risk_return"),
    )


def streaks(returns: DataFrame, column: str, by: str = "code") -> DataFrame:
    """Longest runs of gains and of losses: rows whose places differ alike are one run."""
    sign = F.signum(F.col(column)).cast("int")
    rows = returns.where(F.col(column).isNotNull()).select(by, "date_", sign.alias("sign"))
    place, own = F.row_number().over(Window.partitionBy(by).orderBy("date_")), F.row_number().over(Window.partitionBy(by, "sign").orderBy("date_"))
    runs = rows.select(by, "sign", (place - own).alias("run")).groupBy(by, "sign", "run").agg(F.count("*").alias("n"))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("sign") == s, F.col("n"))), F.lit(0))
    return runs.groupBy(by).agg(longest(1).alias("wins"), longest(-1).alias("losses"))


def drawdown_spells(drawdowns: DataFrame, by: str = "code", column: str = "drawdown") -> DataFrame:
    """Spells below the peak: first and last date, rows, deepest point and its date."""
    over = Window.partitionBy(by).orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)
    spell = F.sum((F.col(column) >= 0).cast("int")).over(over)
    rows = drawdowns.select(by, "date_", F.col(column).alias("dd"), spell.alias("spell")).where("dd < 0")
    return rows.groupBy(by, "spell").agg(F.min("date_").alias("start"), F.max("date_").alias("end"), F.count("*").alias("n"), F.min("dd").alias("deepest"), F.min_by("date_", F.struct("dd", "date_")).alias("valley")).drop("spell")


def against(returns: DataFrame, column: str, benchmark: str, by: str = "code", periods: int = 252) -> DataFrame:
    """Beta, alpha, R squared, information and Treynor ratios of a return to a benchmark column."""
    x, y = F.col(benchmark), F.col(column)
    rows = returns.where(x.isNotNull() & y.isNotNull())
    beta = F.try_divide(F.covar_samp(y, x), F.var_samp(x))
    corr = F.try_divide(F.covar_samp(y, x), F.stddev_samp(x) * F.stddev_samp(y))
    active = y - x
    return rows.groupBy(by).agg(
        beta.alias("beta"),
        ((F.avg(y) - beta * F.avg(x)) * periods).alias("alpha"),
        (corr * corr).alias("r2"),
        F.try_divide(F.avg(active), F.stddev_samp(active)).alias("information"),
        F.try_divide(F.avg(y) * periods, beta).alias("treynor"),
    )


def autocorrelation_penalty(returns: DataFrame, column: str, by: str = "code") -> DataFrame:
    """Factor by which first-order autocorrelation r stretches risk over n rows: sqrt(1 + 2 sum (n-k)/n |r|**k), in closed form."""
    w = Window.partitionBy(by).orderBy("date_")
    rows = returns.select(by, F.col(column).alias("y"), F.lag(column).over(w).alias("x")).where("x is not null and y is not null")
    r = F.abs(F.try_divide(F.covar_samp("y", "x"), F.stddev_samp("x") * F.stddev_samp("y")))
    out = rows.groupBy(by).agg(r.alias("r"), (F.count("*") + 1).cast("double").alias("n"))
    total = F.col("r") / (1 - F.col("r")) - F.col("r") * (1 - F.pow("r", "n")) / (F.col("n") * F.pow(1 - F.col("r"), 2))
    return out.select(by, F.sqrt(1 + 2 * total).alias("penalty"))
