"""Preparation of panels: missing values, outliers, scaling, bins, encodings."""

from __future__ import annotations

from array import array
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null for NaN and infinities, once, at the boundary."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))), F.col(c)) for c in columns})


def impute(df: DataFrame, column: str, how: str, by: Sequence[str] = ("date_",)) -> DataFrame:
    """Fill missing values by the mean, median, or most frequent value of a group, by zero, or forward in time."""
    w = Window.partitionBy(*by)
    if how == "ffill":
        fill: Column = F.last(column, True).over(Window.partitionBy("code").orderBy("date_").rowsBetween(Window.unboundedPreceding, 0))
    elif how == "zero":
        fill = F.lit(0.0)
    else:
        fill = {"mean": F.avg(column), "median": F.percentile(column, 0.5), "min": F.min(column), "max": F.max(column)}[how].over(w)
    return df.withColumn(column, F.coalesce(column, fill))


def fill(df: DataFrame, column: str, how: str, value: float | None = None) -> DataFrame:
    """Fill missing values of a code: from before, from after, between its neighbours by their rows' distance, or by a constant."""
    order = Window.partitionBy("code").orderBy("date_")
    behind, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    x = F.col(column)
    if how == "constant":
        return df.withColumn(column, F.coalesce(x, F.lit(value)))
    if how in ("ffill", "bfill"):
        return df.withColumn(column, F.last(x, True).over(behind) if how == "ffill" else F.first(x, True).over(ahead))
    rows = df.withColumn("__k", F.row_number().over(order)).withColumn("__at", F.when(x.isNotNull(), F.struct("__k", x.alias("v"))))
    rows = rows.withColumn("__a", F.last("__at", True).over(behind)).withColumn("__b", F.first("__at", True).over(ahead))
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("__k") - F.col("__a.__k")) / (F.col("__b.__k") - F.col("__a.__k"))
    return rows.withColumn(column, F.coalesce(x, line, F.col("__a.v"))).drop("__k", "__at", "__a", "__b")


def outliers(df: DataFrame, column: str, how: str = "iqr", width: float = 1.5, by: Sequence[str] = ("date_",)) -> DataFrame:
    """Flag rows outside the quartiles by ``width`` times their distance, beyond ``width`` deviations or scaled median deviations, or beyond the quantiles ``width`` and 1 - ``width``."""
    w, x = Window.partitionBy(*by), F.col(column)
    if how == "mad":
        df = df.withColumn("__far", F.abs(x - F.percentile(x, 0.5).over(w)))
        flag = F.col("__far") > width * 1.4826 * F.percentile("__far", 0.5).over(w)
        return df.withColumn("outlier", F.coalesce(flag, F.lit(False)).cast("int")).drop("__far")
    if how == "quantile":
        flag = (x < F.percentile(x, F.lit(width)).over(w)) | (x > F.percentile(x, F.lit(1 - width)).over(w))
    elif how == "iqr":
        low, high = F.percentile(x, 0.25).over(w), F.percentile(x, 0.75).over(w)
        flag = (x < low - width * (high - low)) | (x > high + width * (high - low))
    else:
        std = F.stddev_pop(x).over(w)
        flag = F.abs(x - F.avg(x).over(w)) > width * std
    return df.withColumn("outlier", F.coalesce(flag, F.lit(False)).cast("int"))


def without_outliers(df: DataFrame, column: str, how: str = "iqr", width: float = 1.5, by: Sequence[str] = ("date_",)) -> DataFrame:
    """Missing where a value is an outlier."""
    return outliers(df, column, how, width, by).withColumn(column, F.when(F.col("outlier") == 0, F.col(column))).drop("outlier")


def woe_encode(df: DataFrame, column: str, target: str, smoothing: float = 0.5) -> DataFrame:
    """Weight of evidence of a bin: log of its share of rows without the target over its share of rows with it."""
    rows = df.where(F.col(column).isNotNull() & F.col(target).isNotNull())
    per_bin = rows.groupBy(column).agg(F.sum(1 - F.col(target)).alias("__good"), F.sum(target).alias("__bad"))
    totals = per_bin.agg(F.sum("__good").alias("__g"), F.sum("__bad").alias("__b"))
    good, bad = (F.col("__good") + smoothing) / (F.col("__g") + smoothing), (F.col("__bad") + smoothing) / (F.col("__b") + smoothing)
    table = per_bin.join(F.broadcast(totals)).select(column, F.log(good / bad).alias("woe"))  # one row
    return df.join(table, column, "left").withColumn("woe", F.when(F.col(target).isNotNull(), F.col("woe")))


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 1.0) -> DataFrame:
    """Mean target of a bin, drawn to the mean of all by a prior of ``smoothing`` rows."""
    rows = df.where(F.col(column).isNotNull() & F.col(target).isNotNull())
    per_bin = rows.groupBy(column).agg(F.sum(target).alias("__s"), F.count("*").alias("__n"))
    totals = per_bin.agg((F.sum("__s") / F.sum("__n")).alias("__m"))
    table = per_bin.join(F.broadcast(totals)).select(column, ((F.col("__s") + F.col("__m") * smoothing) / (F.col("__n") + smoothing)).alias("encoded"))  # one row
    return df.join(table, column, "left")


def chi_square(g1: float, b1: float, g2: float, b2: float) -> float:
    """Chi-square of two bins' rows without and with a 0/1 target."""
    total, out = g1 + b1 + g2 + b2, 0.0
    for have, row, col in ((g1, g1 + b1, g1 + g2), (b1, g1 + b1, b1 + b2), (g2, g2 + b2, g1 + g2), (b2, g2 + b2, b1 + b2)):
        want = row * col / total if total else 0.0
        out += (have - want) * (have - want) / want if want else 0.0
    return out


def merge_bins(counts: Sequence[tuple[float, float, float]] | np.ndarray, most: int, least_chi: float) -> list[float]:
    """Cut points after joining neighbours of the least chi-square, until at most ``most`` are left and all differ by ``least_chi``.

    ``counts`` has (value, rows without the target, rows with it) in the order of the values. Of equal pairs the first is joined.
    """
    values, good, bad = (array("d", c) for c in np.asarray(counts, float).reshape(-1, 3).T)
    n = left = len(values)
    # a bin goes by the place of its first value, and a pair by its first bin
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    now = array("d", (chi_square(good[i], bad[i], good[i + 1], bad[i + 1]) for i in range(n - 1)))
    heap = list(zip(now, range(n - 1), strict=True))
    heapify(heap)
    while heap:
        value, i = heap[0]
        if now[i] == value and left <= most and value >= least_chi:
            break
        heappop(heap)
        if now[i] != value:  # the pair has changed since
            continue
        j = after[i]
        good[i], bad[i], after[i] = good[i] + good[j], bad[i] + bad[j], after[j]
        left -= 1
        if after[i] < n:
            before[after[i]] = i
            now[j] = np.nan
        now[i] = np.nan
        for k in (before[i], i):
            if k >= 0 and after[k] < n:
                now[k] = chi_square(good[k], bad[k], good[after[k]], bad[after[k]])
                heappush(heap, (now[k], k))
        if len(heap) > 2 * left + 1000:
            heap = [(v, k) for k, v in enumerate(now) if v == v]
            heapify(heap)
    cuts, i = [], after[0] if n else 0
    while i < n:
        cuts.append((values[i - 1] + values[i]) / 2)
        i = after[i]
    return cuts


def bin_supervised(df: DataFrame, column: str, target: str, most: int = 5, least_chi: float = 3.841) -> DataFrame:
    """Bins of a value that tell a 0/1 target apart, by merging neighbours.

    The merging starts from every distinct value, and each step needs the least pair of all: three numbers per distinct value go to the driver.
    """
    x = F.col(column)
    there = x.isNotNull() & ~F.isnan(x)
    per_value = df.where(there & F.col(target).isNotNull()).groupBy(x.cast("double").alias("v")).agg(F.sum(1 - F.col(target)).cast("double").alias("g"), F.sum(target).cast("double").alias("b"))
    held = per_value.toArrow()
    counts = np.column_stack([held[c].to_numpy() for c in ("v", "g", "b")])
    cuts = merge_bins(counts[counts[:, 0].argsort()], most, least_chi)
    place = sum(((x > c).cast("int") for c in cuts), F.lit(0))
    return df.withColumn("bin", F.when(there, place))


def natural_breaks(x: np.ndarray, bins: int) -> np.ndarray:
    """Labels 0 to bins - 1 of sorted distinct values with weights 1, that make the sum of squares inside the bins least (exactly, by dynamic programming)."""
    n = len(x)
    s, q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(bins, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            i = np.arange(j)
            cost = best[:j] + q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i)
            cut[j] = int(cost.argmin())
            new[j] = cost[cut[j]]
        best = new
        cuts.append(cut)
    labels, j = np.zeros(n, int), n
    for k in range(len(cuts) - 1, -1, -1):
        labels[cuts[k][j] : j] = k
        j = cuts[k][j]
    return labels


def bin_kmeans(df: DataFrame, column: str, bins: int = 5, by: str = "date_") -> DataFrame:
    """Bins of a date's values with least squares inside, one date per group."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part[column].to_numpy(float)
        some = np.flatnonzero(np.isfinite(x))
        out = np.full(len(x), np.nan)
        order = some[np.argsort(x[some], kind="stable")]
        out[order] = natural_breaks(x[order], bins)
        return part.assign(bin=pd.array([None if np.isnan(v) else int(v) for v in out], dtype="Int32"))

    from pyspark.sql import types as T

    return df.groupBy(by).applyInPandas(run, T.StructType([*df.schema.fields, T.StructField("bin", T.IntegerType())]))


def isolation(df: DataFrame, columns: Sequence[str], share: float = 0.05, trees: int = 50, sample: int = 128, seed: int = 42, by: str = "date_") -> DataFrame:
    """Rows of a date that random cuts set apart soonest: score of an isolation forest, and the flagged share.

    The forest of a date is seeded by its name; rows with a missing value are not flagged.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part[list(columns)].to_numpy(float)
        whole = np.isfinite(x).all(axis=1)
        x, score = x[whole], np.full(len(part), np.nan)
        n = len(x)
        if n > 1:
            rng = np.random.default_rng([seed, *str(part[by].iloc[0]).encode()])
            size = min(sample, n)
            depth = np.zeros(n)
            for _ in range(trees):
                todo = [(rng.choice(n, size, replace=False), np.arange(n), 0)]
                while todo:
                    own, rows, level = todo.pop()
                    low, high = (x[own].min(0), x[own].max(0)) if len(own) else (np.zeros(1), np.zeros(1))
                    split = np.flatnonzero(high > low)
                    if len(own) <= 1 or not len(split) or level >= int(np.ceil(np.log2(size))):
                        depth[rows] += level + _path(len(own))
                        continue
                    k = rng.choice(split)
                    cut = rng.uniform(low[k], high[k])
                    todo += [(own[x[own, k] < cut], rows[x[rows, k] < cut], level + 1), (own[x[own, k] >= cut], rows[x[rows, k] >= cut], level + 1)]
            score[whole] = 2.0 ** (-depth / trees / max(_path(size), 1e-9))
        limit = np.quantile(score[whole], 1 - share) if n > 1 else np.inf
        return part.assign(score=score, outlier=(np.nan_to_num(score, nan=-1.0) > limit).astype("int32"))

    from pyspark.sql import types as T

    return df.groupBy(by).applyInPandas(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("outlier", T.IntegerType())]))


def _path(n: int) -> float:
    """Mean depth of a search that fails in a random tree of n leaves."""
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def orthogonal(df: DataFrame, target: str, exposures: Sequence[str], least: int = 5, by: str = "date_") -> DataFrame:
    """Residual of a column on several others and a constant per date, of dates with enough whole rows; one date is one group's rows."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(part)), part[list(exposures)].to_numpy(float)])
        y = part[target].to_numpy(float)
        return part.assign(residual=y - x @ np.linalg.lstsq(x, y, rcond=None)[0])

    from pyspark.sql import types as T

    whole = df.dropna(subset=[target, *exposures])
    some = whole.withColumn("__n", F.count("*").over(Window.partitionBy(by))).where(F.col("__n") >= least).drop("__n")
    return some.groupBy(by).applyInPandas(run, T.StructType([*some.schema.fields, T.StructField("residual", T.DoubleType())]))


class Preparer:
    """Stages of preparation in order: fill, outliers, neutralise, scale; each is a name of a way or None."""

    def __init__(self, column: str, missing: str | None = "median", outliers: str | None = "mad", neutralize: str | None = None, scale: str | None = "zscore", bins: int | None = None):
        self.column, self.missing, self.outliers, self.neutralize, self.scale, self.bins = column, missing, outliers, neutralize, scale, bins

    def transform(self, df: DataFrame) -> DataFrame:
        """Nothing is learned from other rows than a date's own (or a code's), so the stages need no fit."""
        from quantloom.functions.dsl import call, col
        from quantloom.functions.expr import lower

        out = df
        if self.missing:
            out = fill(out, self.column, self.missing) if self.missing in ("ffill", "bfill", "interpolate") else impute(out, self.column, self.missing)
        x = col(self.column)
        if self.outliers:
            x = call("winsorize_cross_section", x, self.outliers)
        if self.neutralize:
            x = call("neutralize_cross_section", x, self.neutralize)
        if self.scale:
            x = call("normalize_cross_section", x, self.scale)
        made = {self.column: x} | ({"bin": call("cs_quantile", x, self.bins)} if self.bins else {})
        return lower(out, made, keep=[c for c in df.columns if c != self.column])


def bin_width(df: DataFrame, column: str, bins: int, by: Sequence[str] = ("date_",)) -> DataFrame:
    """Bin 0 to bins - 1 of equal width; a value on an edge belongs below it."""
    w, x = Window.partitionBy(*by), F.col(column)
    low, high = F.min(x).over(w), F.max(x).over(w)
    place = F.ceil(F.round((x - low) / (high - low) * bins, 9)) - 1
    return df.withColumn("bin", F.when(high > low, F.greatest(place, F.lit(0))).cast("int"))


def bin_edges(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Bin by given rising edges, open on the left."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        out = F.when((F.col(column) > edges[i - 1]) & (F.col(column) <= edges[i]), i - 1).otherwise(out)
    return df.withColumn("bin", out)


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.select("*", *(F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{i}") for i, v in enumerate(values)))


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Rank of a category among the sorted categories, from 0. The categories are a small table joined back."""
    names = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(f"{column}_id", F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(names, column, "left")


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias(f"{column}_n"))
    return df.join(counts, column)
