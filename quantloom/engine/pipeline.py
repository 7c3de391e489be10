"""Pipelines: named columns over the columns of datasets, computed per day for all codes, and a screen.

A pipeline is a set of lazy expressions. Running it joins the datasets that it names
on date and code, lowers all expressions together, and keeps the rows of the output dates that pass
the screen. Windows see :data:`LOOKBACK` days before the first output date.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.dsl import call
from quantloom.functions.expr import Expr, Frame, col, lower
from quantloom.operators.align import dedupe_last

#: Days before the first output date that windows may look back.
LOOKBACK = 400


@dataclass(frozen=True)
class Dataset:
    """A long table of ``(date_, code, ...)`` by name; its columns are ``name__column`` in expressions."""

    name: str
    frame: DataFrame
    #: Columns that order rows of one date and code; the last counts.
    order: tuple[str, ...] = ()
    #: Whether a value holds until the next one.
    fill: bool = False

    def column(self, name: str) -> Expr:
        if name not in self.frame.columns:
            raise KeyError(f"{self.name} has no column {name}")
        return col(f"{self.name}__{name}")

    def __getitem__(self, name: str) -> Expr:
        return self.column(name)


def returns(x: Expr, n: int = 2) -> Expr:
    """Change over a window of n rows, that is n - 1 steps."""
    return call("pct_change", x, n - 1)


def moving_average(x: Expr, n: int) -> Expr:
    """Mean of the values there are in the last n rows."""
    return call("ts_mean", x, n, 1)


def rolling_deviation(x: Expr, n: int) -> Expr:
    return call("ts_std", x, n, 0, 1)


@dataclass(frozen=True)
class CustomFactor:
    """A function of the last ``window`` dates of its inputs for all codes at once.

    ``compute(date, codes, *arrays)`` gets one array (window x codes) per input and returns a value
    per code. It sees whole dates, so it runs on windows of dates: each task gets the dates of one chunk
    and the window before it. What expressions can say should be an expression.
    """

    inputs: tuple[Expr, ...]
    window: int
    compute: Callable[..., np.ndarray]


@dataclass
class Pipeline:
    columns: dict[str, Expr | CustomFactor] = field(default_factory=dict)
    screen: Expr | None = None

    def add(self, name: str, value: Expr | CustomFactor) -> Pipeline:
        if name in self.columns:
            raise KeyError(f"the pipeline has a column {name}")
        self.columns[name] = value
        return self


#: Output dates that one task of a custom factor computes.
CHUNK = 64


class Engine:
    """Runs pipelines over datasets."""

    def __init__(self, *datasets: Dataset, frame: Frame | None = None):
        self.datasets, self.frame = datasets, frame or Frame()

    def panel(self, start: dt.date | None = None, end: dt.date | None = None, lookback: int = LOOKBACK) -> DataFrame:
        """The datasets side by side on all dates and codes that any of them has; only the days that are needed are scanned."""
        parts = []
        for d in self.datasets:
            rows = d.frame
            if start is not None:
                rows = rows.where(F.col("date_") >= F.lit(start - dt.timedelta(days=lookback)))
            if end is not None:
                rows = rows.where(F.col("date_") <= F.lit(end))
            if d.order:
                rows = dedupe_last(rows, ["date_", "code"], list(d.order))
            parts.append(rows.select("date_", "code", *(F.col(c).alias(f"{d.name}__{c}") for c in rows.columns if c not in ("date_", "code"))))
        whole = reduce(lambda a, b: a.join(b, ["date_", "code"], "full"), parts)
        held = [f"{d.name}__{c}" for d in self.datasets if d.fill for c in d.frame.columns if c not in ("date_", "code")]
        so_far = self.frame.rows(None)
        return whole.withColumns({c: F.last(c, True).over(so_far) for c in held}) if held else whole

    def run(self, pipeline: Pipeline, start: dt.date | None = None, end: dt.date | None = None, lookback: int = LOOKBACK) -> DataFrame:
        """``date_, code`` and the columns, on the output dates, where the screen holds."""
        panel = self.panel(start, end, lookback)
        plain = {n: e for n, e in pipeline.columns.items() if isinstance(e, Expr)}
        if pipeline.screen is not None:
            plain["__screen"] = call("bool", pipeline.screen)
        custom = {n: f for n, f in pipeline.columns.items() if isinstance(f, CustomFactor)}
        inputs = {f"__{n}_{i}": e for n, f in custom.items() for i, e in enumerate(f.inputs)}
        out = lower(panel, plain | inputs, self.frame)
        for n, f in custom.items():
            out = out.join(_custom(out, n, f), ["date_", "code"], "left")
        if start is not None:
            out = out.where(F.col("date_") >= F.lit(start))
        if pipeline.screen is not None:
            out = out.where("__screen = 1")
        return out.select("date_", "code", *pipeline.columns)


def _custom(rows: DataFrame, name: str, factor: CustomFactor) -> DataFrame:
    """Values of a custom factor; the dates are dealt in chunks, each with the window of dates before it."""
    from quantloom.operators.align import sessions

    names = [f"__{name}_{i}" for i in range(len(factor.inputs))]
    calendar = sessions(rows)  # a row per date
    own = F.floor((F.col("k") - 1) / CHUNK)
    last = F.floor((F.col("k") - 2 + factor.window) / CHUNK)
    dealt = rows.select("date_", "code", *names).join(F.broadcast(calendar), "date_").withColumn("chunk", F.explode(F.sequence(own, F.greatest(own, last))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        chunk = int(part["chunk"].iloc[0])
        wide = [part.pivot(index="k", columns="code", values=c).sort_index() for c in names]
        dates = part.drop_duplicates("k").set_index("k")["date_"]
        out = []
        for place, k in enumerate(wide[0].index):
            if (k - 1) // CHUNK != chunk or place + 1 < factor.window:
                continue
            arrays = [w.iloc[place + 1 - factor.window : place + 1].to_numpy(float) for w in wide]
            value = factor.compute(dates[k], wide[0].columns.to_numpy(), *arrays)
            out.append(pd.DataFrame({"date_": dates[k], "code": wide[0].columns, name: np.asarray(value, float)}))
        return pd.concat(out, ignore_index=True) if out else part.iloc[:0][["date_", "code"]].assign(**{name: np.zeros(0)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = dealt.groupBy("chunk").applyInPandas(run, f"date_ {kinds['date_']}, code {kinds['code']}, {name} double")
    return found.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def run_pipeline(pipeline: Pipeline, *datasets: Dataset, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    return Engine(*datasets).run(pipeline, start, end)
