"""Alignment of long frames: deduplicated merges, dense bases, lags, as-of joins, holding periods."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order``, which must make rows distinct."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*")


def merge_by_keys(frames: dict[str, DataFrame], keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join frames on shared keys; value columns are prefixed ``name__``. Full joins keep the keys of all sides."""
    named = [df.select(*keys, *(F.col(c).alias(f"{name}__{c}") for c in df.columns if c not in keys)) for name, df in frames.items()]
    return reduce(lambda a, b: a.join(b, list(keys), how), named)


def dense(df: DataFrame, date: str = "date_", code: str = "code") -> DataFrame:
    """All dates by all codes, with the frame's values where it has some.

    The base is the product of both axes, and that is what a dense panel is: a cross join of the distinct codes with
    the distinct dates, a row per day, which are broadcast up to MOST_DATES.
    """
    dates, codes = df.select(date).distinct(), df.select(code).distinct()
    if dates.count() <= MOST_DATES:
        dates = F.broadcast(dates)
    return codes.crossJoin(dates).join(df, [date, code], "left")


#: Dates that are broadcast (of 8 bytes each).
MOST_DATES = 100_000


def sessions(df: DataFrame, date: str = "date_") -> DataFrame:
    """Distinct dates numbered from 1; one row per trading day, whatever the data's size."""
    return df.select(date).distinct().withColumn("k", F.row_number().over(Window.orderBy(date)))


def lag_sessions(df: DataFrame, calendar: DataFrame, n: int, date: str = "date_") -> DataFrame:
    """Move a feed's dates on by n sessions: first to the session on or after, then n further. Beyond the end they go."""
    snapped = snap(df, calendar, date)
    moved = calendar.select((F.col("k") - n).alias("k"), F.col(date).alias("__moved"))
    rest = [c for c in df.columns if c != date]
    return snapped.join(moved, "k").select(F.col("__moved").alias(date), *rest)


def snap(df: DataFrame, calendar: DataFrame, date: str = "date_") -> DataFrame:
    """The number ``k`` of the first session on or after each row's date; rows after the last session go.

    Sessions are days. Only the distinct days of the events are merged with them, in one sorted pass: at most a row per
    day, however many events or times of day there are. No range join.
    """
    kind = df.schema[date].dataType
    days = df.select(F.to_date(date).alias("__day")).distinct()
    both = days.join(calendar.select(F.to_date(date).alias("__day"), "k"), "__day", "full")
    ahead = both.select("__day", F.first("k", True).over(Window.orderBy("__day").rowsBetween(0, Window.unboundedFollowing)).alias("k")).where("k is not null")
    out = df.withColumn("__day", F.to_date(date)).join(F.broadcast(ahead), "__day").drop("__day")  # a row per day
    return out.withColumn(date, F.col(date).cast(kind))


def asof(panel: DataFrame, events: DataFrame, values: Sequence[str], *, lag: int = 0, date: str = "date_", code: str = "code", order: Sequence[str] = ()) -> DataFrame:
    """Point-in-time join: each panel row gets the last event of its code known ``lag`` sessions before.

    Events snap to the next session of the panel; of several on a session the last by
    (date, order) wins. One window per code fills forward.
    """
    calendar = sessions(panel, date)
    events = events.select(code, date, F.struct(date, *order).alias("__order"), *(F.col(v).alias(f"__v_{v}") for v in values))
    placed = snap(events, calendar, date).withColumn("__k", F.col("k") + lag)
    best = placed.groupBy(code, "__k").agg(*(F.max_by(f"__v_{v}", "__order").alias(v) for v in values), F.lit(True).alias("__hit"))
    rows = panel.join(calendar.withColumnRenamed("k", "__k"), date).select("*", F.lit(1).alias("__row"))
    both = rows.join(best, [code, "__k"], "full")
    w = Window.partitionBy(code).orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select(*(c for c in rows.columns), *(F.last(F.when(F.col("__hit"), F.struct(F.col(v))), True).over(w)[v].alias(v) for v in values))
    return filled.where("__row = 1").drop("__row", "__k")


def holding(daily: DataFrame, rebalances: DataFrame, date: str = "date_") -> DataFrame:
    """The rebalance date each day belongs to: the last one before it. An equi-join replaces the range join."""
    days = daily.select(date).distinct()
    marks = rebalances.select(F.col(date)).distinct().withColumn("__r", F.col(date))
    both = days.join(marks, date, "full")
    period = both.select(date, F.last("__r", True).over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)).alias("rebalance"))
    return daily.join(period.where("rebalance is not null"), date)


def widen(df: DataFrame, keys: Sequence[str], names: str, values: str, columns: Sequence[str], how: str = "last", order: str | None = None) -> DataFrame:
    """One column per stated name; several values of a cell go by ``how`` (the last by ``order``)."""
    x = F.max_by(values, order) if how == "last" and order else {"last": F.last, "first": F.first, "sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how](values)
    return df.groupBy(*keys).pivot(names, list(columns)).agg(x)


def lengthen(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def calendar_steps(calendar: DataFrame, n: int, date: str = "date_") -> DataFrame:
    """The session n further on, and the number of sessions since the first: one row per session."""
    return calendar.select(date, F.lead(date, n).over(Window.orderBy("k")).alias("later"), (F.col("k") - 1).cast("long").alias("since"))


def adjusted(df: DataFrame, ratio: str, columns: Sequence[str], code: str = "code", date: str = "date_") -> DataFrame:
    """Prices before a split or dividend times the ratios of all later ones, so that the last prices stay."""
    later = Window.partitionBy(code).orderBy(date).rowsBetween(1, Window.unboundedFollowing)
    factor = F.coalesce(F.product(F.col(ratio)).over(later), F.lit(1.0))
    return df.withColumn("__f", factor).withColumns({c: F.col(c) * F.col("__f") for c in columns}).drop("__f")


def stride(df: DataFrame, n: int, code: str = "code", date: str = "date_") -> DataFrame:
    """Every n-th row of a code, from its first."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(code).orderBy(date))).where(F.pmod(F.col("__k") - 1, F.lit(n)) == 0).drop("__k")


def fractions(df: DataFrame, column: str, share: float, date: str = "date_", code: str = "code") -> DataFrame:
    """The top and bottom share of a date's rows, one row each at least; ties go by code."""
    w, x = Window.partitionBy(date), F.round(column, 9)
    rows = df.where(F.col(column).isNotNull())
    most = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share))
    side = F.when(F.row_number().over(w.orderBy(x.desc(), code)) <= most, "top").when(F.row_number().over(w.orderBy(x, code)) <= most, "bottom")
    return rows.withColumn("side", side).where("side is not null")


def limit_codes(df: DataFrame, n: int, code: str = "code") -> DataFrame:
    """Rows of the first n codes: a report's limit."""
    return df.join(F.broadcast(df.select(code).distinct().orderBy(code).limit(n)), code, "left_semi")  # n rows
