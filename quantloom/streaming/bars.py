"""Bars from ticks, snapshots of the last bars, and the partitioned tick sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(ticks: DataFrame, width: str, *, time: str = "ts", code: str = "code", price: str = "price", size: str = "size", key: str = "seq", watermark: str | None = None) -> DataFrame:
    """Open, high, low, close and volume per code and window; the same plan for tables and streams.

    ``key`` orders ticks of one instant.
    """
    source = ticks.withWatermark(time, watermark) if watermark else ticks
    at = F.struct(F.col(time), F.col(key))
    return (
        source.groupBy(F.col(code).alias("code"), F.window(time, width).alias("w"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(size).alias("volume"), F.count("*").alias("n"))
        .select("code", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "n")
    )


def snapshots(stream: DataFrame, length: int = 256) -> DataFrame:
    """Return, volatility and range over the last ``length`` bars of each code, as bars arrive.

    The state holds at most ``length`` closes, highs and lows per code.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(state.get[0]) if state.exists else [], columns=["start", "high", "low", "close"]).astype({"high": float, "low": float, "close": float})
        for part in parts:
            held = pd.concat([held, part[["start", "high", "low", "close"]].assign(start=part["start"].astype("int64"))], ignore_index=True)
        held = held.drop_duplicates("start", keep="last").sort_values("start").tail(length)
        state.update(([tuple(map(float, r)) for r in held.itertuples(index=False)],))
        closes = held["close"]
        change = closes.pct_change(fill_method=None)
        yield pd.DataFrame({"code": [key[0]], "bars": [len(held)], "ret": [closes.iloc[-1] / closes.iloc[0] - 1], "volatility": [change.std()], "amplitude": [held["high"].max() / held["low"].min() - 1]})

    return stream.groupBy("code").applyInPandasWithState(
        step, "code string, bars long, ret double, volatility double, amplitude double", "bars array<struct<start: double, high: double, low: double, close: double>>", "update", GroupStateTimeout.NoTimeout
    )


def tick_sink(ticks: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append ticks as Parquet partitioned by symbol and trade date, exactly once."""
    return ticks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("symbol", "trade_date").outputMode("append")


def raw_sink(messages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append raw messages as lines of JSON."""
    return messages.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def sessions(rows: DataFrame, gap: str, by: str, *aggregates, time: str = "ts", watermark: str | None = None) -> DataFrame:
    """Aggregates of a key's sessions, which end after ``gap`` without a row; the same plan for tables and streams."""
    source = rows.withWatermark(time, watermark) if watermark else rows
    out = source.groupBy(by, F.session_window(time, gap).alias("w")).agg(*aggregates)
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in out.columns if c not in (by, "w")))


def sliding(rows: DataFrame, width: str, step: str, by: str, *aggregates, time: str = "ts", watermark: str | None = None) -> DataFrame:
    """Aggregates of overlapping windows of ``width``, one starting every ``step``."""
    source = rows.withWatermark(time, watermark) if watermark else rows
    out = source.groupBy(by, F.window(time, width, step).alias("w")).agg(*aggregates)
    return out.select(by, F.col("w.start").alias("start"), *(c for c in out.columns if c not in (by, "w")))


def once(stream: DataFrame, keys: list[str], *, time: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """The first of rows with equal keys and time that arrive within the watermark."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([*keys, time])
