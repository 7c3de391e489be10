"""Operators of monthly panels with gaps: windows and lags by the calendar, filled gaps, quantile groups, sorted portfolios.

A month is a whole number (:func:`month_number`); frames range over it, so a missing month is a gap and no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGGREGATES = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count, "median": lambda x: F.percentile(x, 0.5), "first": lambda x: F.first(x, True)}


def month_number(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def _months(first: int, last: int, by: str = "code"):
    return Window.partitionBy(by).orderBy(month_number(F.col("date_"))).rangeBetween(first, last)


def over_months(df: DataFrame, column: str, months: int, stat: str = "mean", least: int = 1) -> Column:
    """A statistic of the values of the last ``months`` calendar months; null for fewer than ``least`` values."""
    w = _months(-(months - 1), 0)
    return F.when(F.count(column).over(w) >= least, _AGGREGATES[stat](F.col(column)).over(w))


def months_before(column: str, months: int) -> Column:
    """The value exactly so many calendar months before; null where that month has no row."""
    return F.max(column).over(_months(-months, -months))


def with_lags(df: DataFrame, columns: Sequence[str], months: Sequence[int]) -> DataFrame:
    return df.select("*", *(months_before(c, n).alias(f"l{n}_{c}") for c in columns for n in months))


def filled_months(df: DataFrame) -> DataFrame:
    """A row for every month between a code's first and last; what was missing is null."""
    spans = df.groupBy("code").agg(F.min("date_").alias("a"), F.max("date_").alias("b"))
    every = spans.select("code", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("date_"))
    return every.join(df.withColumn("date_", F.trunc("date_", "month")), ["date_", "code"], "left")


def held_for(column: str, months: int) -> Column:
    """The last value of this and the ``months`` before, as of a quarter's report."""
    return F.last(column, True).over(_months(-months, 0))


def quantile_group(column: str, n: int, by: Sequence[str] = ("date_",)) -> Column:
    """Group 1 to n by the cut points of a date's values; a value on a cut point belongs below it."""
    cuts = F.percentile(column, F.array(*(F.lit(i / n) for i in range(1, n)))).over(Window.partitionBy(*by))
    x = F.col(column)
    return F.when(x.isNotNull(), F.size(F.filter(cuts, lambda c: x > c + F.abs(c) * 1e-12)) + 1)


def relative_rank(column: str, by: Sequence[str] = ("date_",)) -> Column:
    """Share of a date's values that are not above this one."""
    w = Window.partitionBy(*by)
    at_most = F.rank().over(w.orderBy(F.col(column).asc_nulls_last())) + F.count(column).over(Window.partitionBy(*by, column)) - 1
    return F.when(F.col(column).isNotNull(), at_most / F.count(column).over(w))


def clipped(column: str, low: float = 0.01, high: float = 0.99, *, trim: bool = False, by: Sequence[str] = ("date_",)) -> Column:
    """Values beyond a group's quantiles set to these, or with ``trim`` missing."""
    w, x = Window.partitionBy(*by), F.col(column)
    lo, hi = F.percentile(x, F.lit(low)).over(w), F.percentile(x, F.lit(high)).over(w)
    return F.when((x >= lo) & (x <= hi), x) if trim else F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def sorted_portfolios(df: DataFrame, signal: str, ret: str, n: int = 5, *, weight: str | None = None) -> DataFrame:
    """Return of every quantile group in the month after it was formed, equal or weighted by a column at formation."""
    formed = df.select("date_", "code", ret, quantile_group(signal, n).alias("__g"), (F.col(weight) if weight else F.lit(1.0)).alias("__w"))
    held = formed.select("date_", ret, months_before("__g", 1).alias("port"), months_before("__w", 1).alias("__w")).where(f"port is not null and __w is not null and {ret} is not null")
    return held.groupBy("date_", "port").agg(F.try_divide(F.sum(F.col(ret) * F.col("__w")), F.sum("__w")).alias("ret"), F.count("*").alias("n"))


def long_short(portfolios: DataFrame, n: int = 5) -> DataFrame:
    """The last group less the first, per month."""
    top, low = (F.max(F.when(F.col("port") == k, F.col("ret"))) for k in (n, 1))
    return portfolios.groupBy("date_").agg((top - low).alias("ret"))


def industry_of(df: DataFrame, ranges: DataFrame, column: str = "sic") -> DataFrame:
    """The industry of a classification whose table of code ranges ``(low, high, industry)`` is given; ranges are expanded to codes of four digits, so the join is by equality."""
    codes = ranges.select(F.explode(F.sequence("low", "high")).alias(column), "industry")
    return df.join(F.broadcast(codes), column, "left")  # at most 10,000 codes
