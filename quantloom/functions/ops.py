"""Operators of the expression language as Spark columns: row-wise, over time, across codes, in groups."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.functions.expr import CROSS, GROUP, TIME, Frame, op

#: Makes the median absolute deviation of normal data its standard deviation (fixed value).
MAD = 1.4826
#: Below this share of the square of the size, a variance is rounding noise.
FLAT = 1e-12
#: Below this share of the size of what was subtracted, a residual is rounding noise.
NOISE = 1e-12
#: Below this share of their size, two values of a window differ by rounding noise.
APART = 1e-14


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def truth(x: Column) -> Column:
    """A comparison with a missing side is false."""
    return F.coalesce(x, F.lit(False))


# -- row-wise ---------------------------------------------------------------


@op("add")
def _add(f, a, b):
    return a + b


@op("sub")
def _sub(f, a, b):
    return a - b


@op("mul")
def _mul(f, a, b):
    return a * b


@op("div")
def _div(f, a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


@op("pow")
def _pow(f, a, b):
    return finite(F.pow(a.cast("double"), b.cast("double")))


@op("signed_power")
def _signed_power(f, a, b):
    return F.signum(a) * F.pow(F.abs(a), b.cast("double"))


@op("neg")
def _neg(f, a):
    return -a


@op("abs")
def _abs(f, a):
    return F.abs(a)


@op("log")
def _log(f, a):
    return F.when(a > 0, F.log(a))


@op("exp")
def _exp(f, a):
    return finite(F.exp(a))


@op("sqrt")
def _sqrt(f, a):
    return F.when(a >= 0, F.sqrt(a))


@op("sign")
def _sign(f, a):
    return F.signum(a.cast("double"))


@op("lt")
def _lt(f, a, b):
    return truth(a < b)


@op("le")
def _le(f, a, b):
    return truth(a <= b)


@op("gt")
def _gt(f, a, b):
    return truth(a > b)


@op("ge")
def _ge(f, a, b):
    return truth(a >= b)


@op("eq")
def _eq(f, a, b):
    return truth(a == b)


@op("ne")
def _ne(f, a, b):
    return F.coalesce(a != b, F.lit(True))


@op("and")
def _and(f, a, b):
    return a & b


@op("or")
def _or(f, a, b):
    return a | b


@op("not")
def _not(f, a):
    return ~a


@op("bool")
def _bool(f, a):
    return truth(a).cast("double")


@op("ifelse")
def _ifelse(f, c, a, b):
    return F.when(truth(c), a).otherwise(b)


@op("where")
def _where(f, x, c):
    return F.when(truth(c), x)


@op("mask")
def _mask(f, x, c):
    return F.when(~truth(c), x)


@op("fillna")
def _fillna(f, x, v):
    return F.coalesce(x, v)


@op("isna")
def _isna(f, x):
    return x.isNull()


@op("notna")
def _notna(f, x):
    return x.isNotNull()


@op("clip")
def _clip(f, x, lo, hi):
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


@op("clip_lower")
def _clip_lower(f, x, lo):
    return F.when(x.isNotNull(), F.greatest(x, lo))


@op("clip_upper")
def _clip_upper(f, x, hi):
    return F.when(x.isNotNull(), F.least(x, hi))


@op("max2")
def _max2(f, a, b):
    return F.greatest(a, b)


@op("min2")
def _min2(f, a, b):
    return F.least(a, b)


@op("replace")
def _replace(f, x, old, new):
    return F.when(x == old, new).otherwise(x)


@op("round")
def _round(f, x, n):
    return F.round(x, n) if isinstance(n, int) else F.round(x, 9)


@op("bucket")
def _bucket(f, x, n):
    """Number from 1 of the bucket of a share."""
    return F.when(x.isNotNull(), F.greatest(F.ceil(F.round(x * F.lit(n), 9)), F.lit(1))).cast("double")


@op("sin")
def _sin(f, x):
    return F.sin(x)


# -- over time, per code ----------------------------------------------------


def full(f: Frame, x: Column, n: int, e: Column, least: int | None = None) -> Column:
    return F.when(F.count(x).over(f.rows(n)) >= (n if least is None else least), e)


def simple(name: str, agg):
    @op(name, TIME)
    def build(f: Frame, x: Column, n: int, least: int | None = None) -> Column:
        return full(f, x, n, agg(x).over(f.rows(n)), least)


simple("ts_sum", F.sum)
simple("ts_mean", F.avg)
simple("ts_min", F.min)
simple("ts_max", F.max)
simple("ts_product", F.product)
simple("ts_count", F.count)
simple("ts_median", lambda x: F.percentile(x, 0.5))


@op("ts_quantile", TIME)
def _ts_quantile(f, x, n, q, least=None):
    return full(f, x, n, F.percentile(x, F.lit(q)).over(f.rows(n)), least)


@op("ts_std", TIME)
def _ts_std(f, x, n, ddof=1, least=None):
    return full(f, x, n, (F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(f.rows(n)), least)


@op("ts_var", TIME)
def _ts_var(f, x, n, ddof=1, least=None):
    return full(f, x, n, (F.var_samp(x) if ddof else F.var_pop(x)).over(f.rows(n)), least)


@op("ts_skew", TIME)
def _ts_skew(f, x, n, least=None):
    """Bias-corrected, as Spark's own is of the population; null below three values."""
    w = f.rows(n)
    c = F.count(x).over(w)
    flat = (F.var_pop(x).over(w) > FLAT) & (c > 2)
    return full(f, x, n, F.when(flat, F.skewness(x).over(w) * F.sqrt(c * (c - 1)) / (c - 2)), least)


@op("ts_kurt", TIME)
def _ts_kurt(f, x, n, least=None):
    w = f.rows(n)
    c = F.count(x).over(w)
    flat = (F.var_pop(x).over(w) > FLAT) & (c > 3)
    return full(f, x, n, F.when(flat, (F.kurtosis(x).over(w) * (c + 1) + 6) * (c - 1) / ((c - 2) * (c - 3))), least)


@op("ts_zscore", TIME)
def _ts_zscore(f, x, n, ddof=1, least=None):
    w = f.rows(n)
    sd = (F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(w)
    return full(f, x, n or 2, F.when(sd > 1e-9, (x - F.avg(x).over(w)) / sd), least) if n else F.when((F.count(x).over(w) >= (least or 2)) & (sd > 1e-9), (x - F.avg(x).over(w)) / sd)


@op("ts_argmax", TIME)
def _ts_argmax(f, x, n):
    """Place of the first largest value, from 0 at the window's start."""
    w = f.rows(n)
    return full(f, x, n, (F.array_position(F.collect_list(x).over(w), F.max(x).over(w)) - 1).cast("double"))


@op("ts_argmin", TIME)
def _ts_argmin(f, x, n):
    w = f.rows(n)
    return full(f, x, n, (F.array_position(F.collect_list(x).over(w), F.min(x).over(w)) - 1).cast("double"))


@op("ts_rank", TIME)
def _ts_rank(f, x, n, least=None):
    """Percentile rank of the last value among those of its window; ties share their mean rank."""
    held = F.collect_list(x).over(f.rows(n))
    below, same = F.size(F.filter(held, lambda e: e < x)), F.size(F.filter(held, lambda e: e == x))
    return full(f, x, n, F.when(x.isNotNull(), (below + (same + 1) / 2) / F.size(held)), least)


def both(x: Column, y: Column) -> tuple[Column, Column]:
    """Values of the rows that have both."""
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def step(f: Frame, x: Column) -> Column:
    """Sign of the change from a code's row before; null where it is rounding noise."""
    last = F.lag(x).over(f.time)
    least = F.greatest(F.lit(1e-9 * math.sqrt(2)), F.lit(APART) * (F.abs(x) + F.abs(last)))
    return F.when(F.abs(x - last) > least, F.signum((x - last).cast("double")))


@op("ts_corr", TIME)
def _ts_corr(f, x, y, n, least=None):
    x, y = both(x, y)
    w = f.rows(n)
    if n == 2:
        # a line goes through two points, so it is 1 or -1: moments of large values that differ little would round it to neither
        return full(f, x, n, step(f, x) * step(f, y), least)
    sx, sy = F.stddev_samp(x).over(w), F.stddev_samp(y).over(w)
    # rounded, as rounding noise would make an order among equal correlations
    return full(f, x, n, F.when((sx > 1e-9) & (sy > 1e-9), F.round(F.covar_samp(x, y).over(w) / (sx * sy), 9)), least)


@op("ts_cov", TIME)
def _ts_cov(f, x, y, n, least=None):
    x, y = both(x, y)
    return full(f, x, n, F.covar_samp(x, y).over(f.rows(n)), least)


@op("ts_beta", TIME)
def _ts_beta(f, y, x, n, least=None):
    y, x = both(y, x)
    w = f.rows(n)
    var = F.var_samp(x).over(w)
    return full(f, x, n, F.when(var > FLAT, F.covar_samp(y, x).over(w) / var), least)


@op("ts_slope", TIME)
def _ts_slope(f, x, n):
    """Slope of a line through the window's values, one apart."""
    held = F.collect_list(x).over(f.rows(n))
    mid, norm = (n - 1) / 2.0, n * (n * n - 1) / 12.0
    weighted = F.aggregate(F.transform(held, lambda v, i: v * (i - F.lit(mid))), F.lit(0.0), lambda a, b: a + b)
    return full(f, x, n, weighted / F.lit(norm))


@op("delay", TIME)
def _delay(f, x, n):
    return F.lag(x, n).over(f.time)


@op("lead", TIME)
def _lead(f, x, n):
    return F.lead(x, n).over(f.time)


@op("delta", TIME)
def _delta(f, x, n):
    return x - F.lag(x, n).over(f.time)


@op("pct_change", TIME)
def _pct_change(f, x, n):
    return F.try_divide(x, F.lag(x, n).over(f.time)) - 1


@op("decay_linear", TIME)
def _decay_linear(f, x, n):
    """Mean with weights 1 to n, the newest heaviest."""
    total = sum((F.lit(float(n - i)) * (F.lag(x, i).over(f.time) if i else x) for i in range(1, n)), F.lit(float(n)) * x)
    return full(f, x, n, total / F.lit(n * (n + 1) / 2.0))


def reach(weight: float) -> int:
    """Rows after which a value's share in a recursive mean is below double precision."""
    return max(2, math.ceil(math.log(1e-17) / math.log1p(-weight))) if weight < 1 else 1


@op("ewm_mean", TIME)
def _ewm_mean(f, x, weight):
    """Recursive mean with ``weight`` on the newest value; it starts with the first value there is.

    Rows beyond :func:`reach` no longer count, which bounds the memory of a row.
    """
    held = F.collect_list(x).over(f.rows(reach(weight)))
    fold = F.aggregate(held, F.lit(None).cast("double"), lambda a, v: F.coalesce(a * F.lit(1 - weight) + v * F.lit(weight), v))
    return F.when(x.isNotNull(), fold)


@op("cumsum", TIME)
def _cumsum(f, x):
    return F.when(x.isNotNull(), F.sum(x).over(f.rows(None)))


@op("cumprod", TIME)
def _cumprod(f, x):
    return F.when(x.isNotNull(), F.product(x).over(f.rows(None)))


@op("cummax", TIME)
def _cummax(f, x):
    return F.when(x.isNotNull(), F.max(x).over(f.rows(None)))


@op("cummin", TIME)
def _cummin(f, x):
    return F.when(x.isNotNull(), F.min(x).over(f.rows(None)))


@op("cumcount", TIME)
def _cumcount(f, x):
    return F.count(x).over(f.rows(None)).cast("double")


@op("ffill", TIME)
def _ffill(f, x, limit=None):
    return F.last(x, True).over(f.rows(None if limit is None else limit + 1))


@op("bfill", TIME)
def _bfill(f, x, limit=None):
    return F.first(x, True).over(f.ahead(limit))


@op("ts_sharpe", TIME)
def _ts_sharpe(f, x, n, periods=252, rate=0.0, least=None):
    """Mean over deviation of what a return has beyond a yearly rate, scaled to a year."""
    w = f.rows(n)
    sd = F.stddev_pop(x).over(w)
    return full(f, x, n, F.when(sd > 1e-9, (F.avg(x).over(w) - F.lit(rate / periods)) / sd * F.lit(float(periods) ** 0.5)), least)


@op("ts_sortino", TIME)
def _ts_sortino(f, x, n, periods=252, rate=0.0, least=None):
    """Mean over the root of the mean square of losses, over all rows of the window."""
    w = f.rows(n)
    e = x - F.lit(rate / periods)
    down = F.sqrt(F.avg(F.when(e < 0, e * e).when(e.isNotNull(), 0.0)).over(w))
    return full(f, x, n, F.when(down > 1e-9, F.avg(e).over(w) / down * F.lit(float(periods) ** 0.5)), least)


@op("ts_ir", TIME)
def _ts_ir(f, x, n, least=None):
    w = f.rows(n)
    sd = F.stddev_pop(x).over(w)
    return full(f, x, n, F.when(sd > 1e-9, F.avg(x).over(w) / sd), least)


@op("ts_max_drawdown", TIME)
def _ts_max_drawdown(f, x, n, least=None):
    """Deepest fall of a curve below its peak inside the window."""
    held = F.collect_list(x).over(f.rows(n))
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("low"))

    def step(a, v):
        peak = F.greatest(a["peak"], v)
        return F.struct(peak.alias("peak"), F.least(a["low"], F.try_divide(v, peak) - 1).alias("low"))

    return full(f, x, n, F.aggregate(held, start, step)["low"], least)


@op("ts_median_dev", TIME)
def _ts_median_dev(f, x, n, least=None):
    """Median distance of a window's values to their median."""
    held = F.collect_list(x).over(f.rows(n))
    mid = F.percentile(x, 0.5).over(f.rows(n))
    far = F.sort_array(F.transform(held, lambda v: F.abs(v - mid)))
    c = F.size(far)
    return full(f, x, n, (F.get(far, F.floor((c - 1) / 2).cast("int")) + F.get(far, F.floor(c / 2).cast("int"))) / 2, least)


@op("time_quantile", TIME)
def _time_quantile(f, x, q):
    """Quantile of all rows of a code."""
    return F.percentile(x, F.lit(q)).over(f.all_time)


@op("ewm_std", TIME)
def _ewm_std(f, x, weight):
    """Recursive deviation with ``weight`` on the newest value, corrected for bias; null for one value.

    The weights of the mean and of the squares are those of :func:`_ewm_mean`; ``w2`` is the sum of their squares.
    """
    held = F.collect_list(x).over(f.rows(reach(weight)))
    start = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0.0).alias("var"), F.lit(1.0).alias("w2"))
    old, new = F.lit(1 - weight), F.lit(weight)

    def step(a, v):
        d = v - a["mean"]
        some = a["mean"].isNotNull()
        return F.struct(
            F.coalesce(a["mean"] + new * d, v).alias("mean"),
            F.when(some, old * (a["var"] + new * d * d)).otherwise(0.0).alias("var"),
            F.when(some, old * old * a["w2"] + new * new).otherwise(1.0).alias("w2"),
        )

    out = F.aggregate(held, start, step)
    return F.when(x.isNotNull() & (F.size(held) > 1), F.sqrt(out["var"] / (1 - out["w2"])))


@op("drawdown", TIME)
def _drawdown(f, x):
    return F.try_divide(x, F.max(x).over(f.rows(None))) - 1


# -- across codes, per date -------------------------------------------------


@op("cs_rank_raw", CROSS)
def _cs_rank_raw(f, x):
    """Mean rank from 1, of the values there are; rounded first, so that noise makes no order."""
    r = F.round(x.cast("double"), 9)
    w = f.cross.orderBy(r.asc_nulls_last())
    ties = F.count(x).over(_same(f, r))
    return F.when(x.isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def _same(f: Frame, r: Column):
    from pyspark.sql import Window

    return Window.partitionBy(F.col(f.date), r)


@op("cs_rank", CROSS)
def _cs_rank(f, x):
    return _cs_rank_raw(f, x) / F.count(x).over(f.cross)


@op("cs_rank_centered", CROSS)
def _cs_rank_centered(f, x):
    return _cs_rank(f, x) - 0.5


@op("cs_demean", CROSS)
def _cs_demean(f, x):
    return x - F.avg(x).over(f.cross)


@op("cs_zscore", CROSS)
def _cs_zscore(f, x, ddof=0):
    sd = (F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(f.cross)
    return F.when(sd > 1e-9, (x - F.avg(x).over(f.cross)) / sd)


@op("cs_median_dev", CROSS)
def _cs_median_dev(f, x):
    """Distance to the date's median; the robust operators build on it."""
    return x - F.percentile(x, 0.5).over(f.cross)


@op("cs_median", CROSS)
def _cs_median(f, x):
    return F.percentile(x, 0.5).over(f.cross)


@op("cs_winsorize", CROSS)
def _cs_winsorize(f, x, lower=0.01, upper=0.99):
    lo, hi = F.percentile(x, F.lit(lower)).over(f.cross), F.percentile(x, F.lit(upper)).over(f.cross)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


@op("cs_minmax", CROSS)
def _cs_minmax(f, x, lo=0.0, hi=1.0):
    low, high = F.min(x).over(f.cross), F.max(x).over(f.cross)
    return F.when(high - low > 1e-9, F.lit(lo) + (x - low) / (high - low) * (hi - lo))


@op("cs_l1", CROSS)
def _cs_l1(f, x):
    return F.try_divide(x, F.sum(F.abs(x)).over(f.cross))


@op("cs_l2", CROSS)
def _cs_l2(f, x):
    return F.try_divide(x, F.sqrt(F.sum(x * x).over(f.cross)))


@op("cs_scale", CROSS)
def _cs_scale(f, x, a=1.0):
    return F.try_divide(x * F.lit(float(a)), F.sum(F.abs(x)).over(f.cross))


@op("cs_mean", CROSS)
def _cs_mean(f, x):
    return F.avg(x).over(f.cross)


@op("cs_sum", CROSS)
def _cs_sum(f, x):
    return F.sum(x).over(f.cross)


@op("cs_count", CROSS)
def _cs_count(f, x):
    return F.count(x).over(f.cross).cast("double")


@op("cs_max", CROSS)
def _cs_max(f, x):
    return F.max(x).over(f.cross)


@op("cs_min", CROSS)
def _cs_min(f, x):
    return F.min(x).over(f.cross)


@op("cs_std", CROSS)
def _cs_std(f, x, ddof=0):
    return (F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(f.cross)


def _place(f: Frame, x: Column, down: bool = False) -> Column:
    r = F.round(x.cast("double"), 9)
    return F.when(x.isNotNull(), F.row_number().over(f.cross.orderBy(r.desc_nulls_last() if down else r.asc_nulls_last(), f.code)))


@op("cs_quantile", CROSS)
def _cs_quantile(f, x, q=5):
    """Bucket 1 to q by place; ties go by code."""
    return F.ceil(_place(f, x) * F.lit(q) / F.count(x).over(f.cross)).cast("double")


@op("cs_qcut", CROSS)
def _cs_qcut(f, x, q=5):
    """Bucket 0 to q - 1 with edges at the quantiles of the places."""
    n = F.count(x).over(f.cross)
    return F.when(n > 1, F.greatest(F.ceil((_place(f, x) - 1) * F.lit(q) / (n - 1)), F.lit(1)) - 1).cast("double")


@op("cs_top", CROSS)
def _cs_top(f, x, n):
    return truth(_place(f, x, True) <= n).cast("double")


@op("cs_bottom", CROSS)
def _cs_bottom(f, x, n):
    return truth(_place(f, x) <= n).cast("double")


@op("cs_residual", CROSS)
def _cs_residual(f, y, x):
    """Residual of a line fitted across the codes of a date; 0 where the line meets the point but for rounding noise."""
    py, px = both(y, x)
    w = f.cross
    var = F.var_samp(px).over(w)
    slope = F.when(var > FLAT, F.covar_samp(py, px).over(w) / var).otherwise(F.lit(0.0))
    left = py - F.avg(py).over(w) - slope * (px - F.avg(px).over(w))
    # two codes are always on their line: what is left of them would make an order by the order of rows
    size = F.max(F.abs(py)).over(w) + F.abs(slope) * F.max(F.abs(px)).over(w)
    return F.when(F.abs(left) < F.lit(NOISE) * size, F.lit(0.0)).otherwise(left)


@op("cs_skew", CROSS)
def _cs_skew(f, x):
    """Bias-corrected skewness of a date; null below three values."""
    c = F.count(x).over(f.cross)
    return F.when((c > 2) & (F.var_pop(x).over(f.cross) > FLAT), F.skewness(x).over(f.cross) * F.sqrt(c * (c - 1)) / (c - 2))


@op("cs_quantile_value", CROSS)
def _cs_quantile_value(f, x, q):
    return F.percentile(x, F.lit(q)).over(f.cross)


@op("cs_corr", CROSS)
def _cs_corr(f, x, y):
    x, y = both(x, y)
    sx, sy = F.stddev_samp(x).over(f.cross), F.stddev_samp(y).over(f.cross)
    return F.when((sx > 1e-9) & (sy > 1e-9), F.covar_samp(x, y).over(f.cross) / (sx * sy))


# -- in groups of a date ----------------------------------------------------


def grouped(name: str, agg):
    @op(name, GROUP)
    def build(f: Frame, x: Column) -> Column:
        return agg(x).over(f.in_group)


grouped("group_mean", F.avg)
grouped("group_min", F.min)
grouped("group_max", F.max)
grouped("group_sum", F.sum)
grouped("group_median", lambda x: F.percentile(x, 0.5))
grouped("group_std", F.stddev_pop)


@op("group_count", GROUP)
def _group_count(f, x):
    return F.count(x).over(f.in_group).cast("double")


@op("group_demean", GROUP)
def _group_demean(f, x, by=None):
    return x - F.avg(x).over(f.group_of(by))


@op("group_weighted_mean", GROUP)
def _group_weighted_mean(f, x, y):
    """Mean of a group weighted by another column, over rows that have both."""
    x, y = both(x, y)
    return F.try_divide(F.sum(x * y).over(f.in_group), F.sum(y).over(f.in_group))


@op("group_backfill", TIME)
def _group_backfill(f, x, n, std=4.0):
    """What is missing, or further than ``std`` deviations from the mean of the last n rows, takes the next value within n rows."""
    w = f.rows(n)
    good = F.when(~(F.abs(x - F.avg(x).over(w)) > F.lit(std) * F.stddev_samp(x).over(w)) | F.stddev_samp(x).over(w).isNull(), x)
    return F.coalesce(good, F.first(x, True).over(f.time.rowsBetween(1, n)))


@op("group_zscore", GROUP)
def _group_zscore(f, x):
    sd = F.stddev_pop(x).over(f.in_group)
    return F.when(sd > 1e-9, (x - F.avg(x).over(f.in_group)) / sd)


@op("group_rank", GROUP)
def _group_rank(f, x):
    from pyspark.sql import Window

    r = F.round(x.cast("double"), 9)
    ties = F.count(x).over(Window.partitionBy(F.col(f.date), F.col(f.group), r))
    place = F.rank().over(f.in_group.orderBy(r.asc_nulls_last())) + (ties - 1) / 2
    return F.when(x.isNotNull(), place / F.count(x).over(f.in_group))


@op("group_fill", GROUP)
def _group_fill(f, x):
    """Missing values take their group's median."""
    return F.coalesce(x, F.percentile(x, 0.5).over(f.in_group))
