"""Evaluation of factors: forward returns, information coefficients, quantile returns, turnover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_returns(prices: DataFrame, periods: Sequence[int], price: str = "close") -> DataFrame:
    """Return of the next n rows of a code, as ``fwd_n``."""
    w = Window.partitionBy("code").orderBy("date_")
    return prices.select("date_", "code", *((F.try_divide(F.lead(price, n).over(w), F.col(price)) - 1).alias(f"fwd_{n}") for n in periods))


def corr_of(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation of a group's complete pairs; null below ``least`` pairs or for a constant side."""
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    sx, sy = F.stddev_samp(px), F.stddev_samp(py)
    return F.when((F.count(px) >= least) & (sx > 1e-9) & (sy > 1e-9), F.covar_samp(px, py) / (sx * sy))


def mean_rank(x: Column, by: Sequence[str]) -> Column:
    parts = [F.col(c) for c in by]
    r = F.round(x, 9)
    ties = F.count(x).over(Window.partitionBy(*parts, r))
    return F.when(x.isNotNull(), F.rank().over(Window.partitionBy(*parts).orderBy(r.asc_nulls_last())) + (ties - 1) / 2)


def information_coefficient(data: DataFrame, factor: str, returns: Sequence[str], method: str = "spearman", by: Sequence[str] = ("date_",)) -> DataFrame:
    """Correlation of factor and forward return per date (and group); ranks are taken among complete pairs."""
    if method == "spearman":
        pairs = data.select(*by, *(F.struct(F.when(F.col(r).isNotNull(), F.col(factor)).alias("x"), F.when(F.col(factor).isNotNull(), F.col(r)).alias("y")).alias(r) for r in returns))
        ranked = pairs.select(*by, *(F.struct(mean_rank(F.col(f"{r}.x"), by).alias("x"), mean_rank(F.col(f"{r}.y"), by).alias("y")).alias(r) for r in returns))
        return ranked.groupBy(*by).agg(*(corr_of(F.col(f"{r}.x"), F.col(f"{r}.y")).alias(f"ic_{r}") for r in returns))
    return data.groupBy(*by).agg(*(corr_of(F.col(factor), F.col(r)).alias(f"ic_{r}") for r in returns))


def ic_summary(ic: DataFrame, column: str) -> DataFrame:
    """Mean, deviation, information ratio, t value, share of positive dates."""
    x = F.col(column)
    mean, std, n = F.avg(x), F.stddev_samp(x), F.count(x)
    ir = F.try_divide(mean, std)
    return ic.agg(n.alias("n"), mean.alias("mean"), std.alias("std"), ir.alias("ir"), (ir * F.sqrt(n)).alias("t"), F.avg((x > 0).cast("double")).alias("positive"), F.avg((F.abs(x) > 0.02).cast("double")).alias("effective"))


def quantiles(data: DataFrame, factor: str, q: int = 5, by: Sequence[str] = ("date_",)) -> DataFrame:
    """Bucket 1 to q of each row by place within its date (and group); ties go by code."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(F.round(factor, 9), "code"))
    kept = data.where(F.col(factor).isNotNull())
    return kept.withColumn("factor_quantile", F.ceil(place * q / F.count("*").over(w)).cast("int"))


def quantile_returns(data: DataFrame, returns: str, by: Sequence[str] = ("factor_quantile",)) -> DataFrame:
    """Mean, deviation, standard error and count of a return per quantile (and date)."""
    x = F.col(returns)
    return data.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"), F.count(x).alias("n"))


def demeaned(data: DataFrame, returns: Sequence[str], by: Sequence[str] = ("date_",)) -> DataFrame:
    w = Window.partitionBy(*by)
    return data.withColumns({r: F.col(r) - F.avg(r).over(w) for r in returns})


def spread(data: DataFrame, returns: str, q: int) -> DataFrame:
    """Return of the top quantile less that of the bottom, per date."""
    top, low = (F.avg(F.when(F.col("factor_quantile") == k, F.col(returns))) for k in (q, 1))
    return data.groupBy("date_").agg((top - low).alias("spread"))


def turnover(data: DataFrame, lag: int = 1) -> DataFrame:
    """Share of a quantile's codes that were not in it ``lag`` dates before."""
    from quantloom.operators.align import sessions

    calendar = sessions(data)
    held = data.select("date_", "code", "factor_quantile").join(calendar, "date_").select("k", "date_", "code", "factor_quantile")
    before = held.select((F.col("k") + lag).alias("k"), "code", "factor_quantile", F.lit(1).alias("was"))
    both = held.join(before, ["k", "code", "factor_quantile"], "left")
    return both.where(F.col("k") > lag).groupBy("date_", "factor_quantile").agg((1 - F.count("was") / F.count("*")).alias("turnover"))


def rank_autocorrelation(data: DataFrame, factor: str, lag: int = 1) -> DataFrame:
    """Correlation of a date's ranks with the ranks of the same codes ``lag`` rows before."""
    w = Window.partitionBy("code").orderBy("date_")
    ranked = data.select("date_", "code", mean_rank(F.col(factor), ("date_",)).alias("r"))
    both = ranked.select("date_", "r", F.lag("r", lag).over(w).alias("before"))
    return both.groupBy("date_").agg(corr_of(F.col("r"), F.col("before")).alias("autocorrelation"))


def factor_weights(data: DataFrame, factor: str) -> DataFrame:
    """Weights of a long-short portfolio: demeaned factor over the sum of its absolute values."""
    w = Window.partitionBy("date_")
    x = data.withColumn("__x", F.col(factor) - F.avg(factor).over(w))
    return x.withColumn("weight", F.try_divide("__x", F.sum(F.abs("__x")).over(w))).drop("__x")


def factor_returns(data: DataFrame, factor: str, returns: str) -> DataFrame:
    return factor_weights(data, factor).groupBy("date_").agg(F.sum(F.col("weight") * F.col(returns)).alias("factor_return"))


def alpha_beta(data: DataFrame, factor: str, returns: str) -> DataFrame:
    """Line of the factor portfolio's return on the universe's mean return."""
    own = factor_returns(data, factor, returns)
    market = data.groupBy("date_").agg(F.avg(returns).alias("market"))
    x, y = F.col("market"), F.col("factor_return")
    both = own.join(market, "date_").where("market is not null and factor_return is not null")
    beta = F.try_divide(F.covar_samp(y, x), F.var_samp(x))
    return both.agg(beta.alias("beta"), (F.avg(y) - beta * F.avg(x)).alias("alpha"), F.count("*").alias("n"))


def event_window(events: DataFrame, returns: DataFrame, column: str, before: int, after: int, by: str = "factor_quantile") -> DataFrame:
    """Mean return of events' codes at each number of sessions from the event, by group.

    Events take an equi-join per offset, and no range join; the sums are partial before the shuffle.
    """
    from quantloom.operators.align import sessions

    calendar = sessions(returns)
    placed = events.join(calendar, "date_").select("code", "k", by).withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after))))
    around = placed.select("code", (F.col("k") + F.col("offset")).alias("k"), "offset", by)
    there = returns.join(calendar, "date_").select("code", "k", F.col(column).alias("r"))
    return around.join(there, ["code", "k"]).groupBy(by, "offset").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.count("r").alias("n"))


def holding_periods(data: DataFrame, prices: DataFrame, factor: str, horizons: Sequence[int], q: int = 5) -> DataFrame:
    """Spread and mean rank correlation of a factor at several horizons: one row per horizon."""
    joined = data.select("date_", "code", factor).join(forward_returns(prices, horizons), ["date_", "code"])
    bucketed = quantiles(joined, factor, q)
    long = bucketed.select("date_", "code", factor, "factor_quantile", F.explode(F.create_map(*(x for n in horizons for x in (F.lit(n), F.col(f"fwd_{n}"))))).alias("horizon", "fwd"))
    ic = information_coefficient(long, factor, ["fwd"], by=("date_", "horizon")).groupBy("horizon").agg(F.avg("ic_fwd").alias("ic"))
    top, low = (F.avg(F.when(F.col("factor_quantile") == k, F.col("fwd"))) for k in (q, 1))
    per_date = long.groupBy("horizon", "date_").agg((top - low).alias("spread"))
    return per_date.groupBy("horizon").agg(F.avg("spread").alias("spread"), F.stddev_samp("spread").alias("std"), F.count("spread").alias("n")).join(ic, "horizon")
