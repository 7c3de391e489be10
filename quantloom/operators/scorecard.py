"""Scorecards of many factors at once, horizon tables, verdicts, and what is built on them.

A long frame holds ``(name, date_, code, factor, fwd_...)``: every step groups by name, so
one job scores any number of factors, and per-date sums are partial before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.evaluation import corr_of, mean_rank


def stacked(panel: DataFrame, factors: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per factor of every row: name, factor, and the columns kept."""
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).cast("double").alias("factor")) for f in factors)))
    return panel.select(*keep, rows.alias("__f")).select("__f.name", *keep, "__f.factor")


def placed(data: DataFrame, q: int = 5, by: Sequence[str] = ("name", "date_")) -> DataFrame:
    """Rows with a factor and its quantile 1 to q; ties go by code."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(F.round("factor", 9), "code"))
    return data.where("factor is not null").withColumn("factor_quantile", F.ceil(place * q / F.count("*").over(w)).cast("int"))


def zero_aware(data: DataFrame, q: int = 4, by: Sequence[str] = ("date_",)) -> DataFrame:
    """Quantiles of negative values below, of others above: each side has q / 2 of them."""
    side = data.where("factor is not null").withColumn("__up", F.col("factor") >= 0)
    w = Window.partitionBy(*by, "__up")
    half = F.ceil(F.row_number().over(w.orderBy(F.round("factor", 9), "code")) * (q // 2) / F.count("*").over(w))
    return side.withColumn("factor_quantile", (half + F.when(F.col("__up"), q // 2).otherwise(0)).cast("int")).drop("__up")


def width_bins(data: DataFrame, bins: int, by: Sequence[str] = ("date_",)) -> DataFrame:
    """Bin 1 to ``bins`` of equal width between a date's least and largest value; a value on an edge belongs below it."""
    w, x = Window.partitionBy(*by), F.col("factor")
    low, high = F.min(x).over(w), F.max(x).over(w)
    place = F.greatest(F.ceil(F.round((x - low) / (high - low) * bins, 9)), F.lit(1)).cast("int")
    return data.where(x.isNotNull()).withColumn("factor_quantile", F.when(high > low, place).otherwise(1))


def legs(data: DataFrame, returns: str, q: int, by: Sequence[str]) -> DataFrame:
    """Mean return of the top and the bottom quantile and their difference."""
    top, low = (F.avg(F.when(F.col("factor_quantile") == k, F.col(returns))) for k in (q, 1))
    return data.groupBy(*by).agg(top.alias("long"), low.alias("short"), (top - low).alias("spread"))


def _signals(data: DataFrame, returns: str, q: int) -> DataFrame:
    """Per name and date: correlations with the return, with the row before of the same codes, moves of ranks, long-short return."""
    w, day = Window.partitionBy("name", "code").orderBy("date_"), Window.partitionBy("name", "date_")
    by = ("name", "date_")
    pair = data.withColumn("__y", F.when(F.col("factor").isNotNull(), F.col(returns))).withColumn("__x", F.when(F.col(returns).isNotNull(), F.col("factor")))
    ranked = pair.select(
        *by, "code", "factor", "__x", "__y",
        mean_rank(F.col("__x"), by).alias("__rx"), mean_rank(F.col("__y"), by).alias("__ry"), mean_rank(F.col("factor"), by).alias("__r"),
        (mean_rank(F.col("factor"), by) / F.count("factor").over(day)).alias("__share"),
    )
    moved = ranked.select("*", F.lag("factor").over(w).alias("__was"), F.lag("__r").over(w).alias("__rwas"), F.abs(F.col("__share") - F.lag("__share").over(w)).alias("__move"))
    c = F.col
    per_date = moved.groupBy(*by).agg(
        corr_of(c("__x"), c("__y")).alias("ic"), corr_of(c("__rx"), c("__ry")).alias("rank_ic"), corr_of(c("factor"), c("__was")).alias("autocorr"), corr_of(c("__r"), c("__rwas")).alias("rank_autocorr"), F.avg("__move").alias("move"),
    )
    return per_date.join(legs(placed(data, q), returns, q, by), list(by), "left")


def evaluate(data: DataFrame, returns: str, *, q: int = 5, periods: int = 252, usage: str | None = None, regime: str | None = None) -> DataFrame:
    """The scorecard of every factor.

    ``fitness`` is (ic + rank ic + ic_ir / 2), damped by turnover, capacity, difference between market regimes,
    and difference between the first and second half of the dates. ``usage`` is a column of liquidity,
    ``regime`` a label per row's date.
    """
    daily = _signals(data, returns, q)
    if regime:
        daily = daily.join(data.groupBy("name", "date_").agg(F.min(regime).alias("__regime")), ["name", "date_"], "left")
    dates = Window.partitionBy("name")
    daily = daily.withColumn("__half", F.row_number().over(dates.orderBy("date_")) <= F.floor(F.count("*").over(dates) / 2))  # a row per factor and date
    c = F.col
    card = daily.groupBy("name").agg(
        F.avg("ic").alias("ic_mean"),
        F.stddev_pop("ic").alias("__ic_std"),
        F.avg("rank_ic").alias("rank_ic_mean"),
        (F.try_divide(F.avg("spread"), F.stddev_pop("spread")) * float(periods) ** 0.5).alias("sharpe"),
        F.avg("move").alias("turnover"),
        F.avg("autocorr").alias("factor_autocorr"),
        F.avg("rank_autocorr").alias("rank_factor_autocorr"),
        F.abs(F.avg(F.when(c("__half"), c("ic"))) - F.avg(F.when(~c("__half"), c("ic")))).alias("__drift"),
    )
    card = card.withColumns({"ic_ir": c("ic_mean") / (c("__ic_std") + 1e-6), "decay_score": 1 / (1 + 5 * c("turnover")), "out_of_sample_stability": 1 / (1 + F.coalesce("__drift", F.lit(0.0)))})
    if usage:
        share = mean_rank(F.abs("factor"), ("name", "date_")) / F.count("factor").over(Window.partitionBy("name", "date_"))
        used = data.select("name", "date_", (F.abs(share - 0.5) / (F.abs(usage) + 1e-6)).alias("__u")).groupBy("name", "date_").agg(F.avg("__u").alias("__u"))
        card = card.join(used.groupBy("name").agg((1 / (1 + F.avg("__u"))).alias("capacity_score")), "name")
    else:
        card = card.withColumn("capacity_score", F.lit(1.0))
    if regime:
        means = daily.where("__regime is not null").groupBy("name", "__regime").agg(F.avg("ic").alias("m")).groupBy("name").agg((1 / (1 + F.stddev_pop("m"))).alias("regime_robustness"))
        card = card.join(means, "name", "left").fillna({"regime_robustness": 1.0})
    else:
        card = card.withColumn("regime_robustness", F.lit(1.0))
    fitness = (c("ic_mean") + c("rank_ic_mean") + 0.5 * c("ic_ir")) * c("decay_score") * c("capacity_score") * c("regime_robustness") * c("out_of_sample_stability") / (1 + c("turnover"))
    return card.select("name", "ic_mean", "ic_ir", "rank_ic_mean", "sharpe", "turnover", "decay_score", "capacity_score", "regime_robustness", "out_of_sample_stability", "factor_autocorr", "rank_factor_autocorr", fitness.alias("fitness"))


# -- horizons ---------------------------------------------------------------


def by_horizon(data: DataFrame, horizons: dict[int, str]) -> DataFrame:
    """A row for every horizon of every row, with its forward return as ``fwd``."""
    rows = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(c).alias("fwd")) for h, c in horizons.items())))
    return data.select("name", "date_", "code", "factor", rows.alias("__h")).select("name", "date_", "code", "factor", "__h.*")


def horizon_table(data: DataFrame, horizons: dict[int, str], *, q: int = 5, periods: int = 252) -> DataFrame:
    """Per factor and horizon: rank correlation and its ratio, long-short growth, risk, Sharpe ratio, turnover, deepest fall."""
    long = by_horizon(data, horizons)
    by = ("name", "horizon", "date_")
    pair = long.withColumn("__x", F.when(F.col("fwd").isNotNull(), F.col("factor"))).withColumn("__y", F.when(F.col("factor").isNotNull(), F.col("fwd")))
    ic = pair.select(*by, mean_rank(F.col("__x"), by).alias("__rx"), mean_rank(F.col("__y"), by).alias("__ry")).groupBy(*by).agg(corr_of(F.col("__rx"), F.col("__ry")).alias("ic"))
    bucketed = placed(long, q, by)
    before = F.lag("factor_quantile").over(Window.partitionBy("name", "horizon", "code").orderBy("date_"))
    changed = bucketed.withColumn("__new", (F.col("factor_quantile") != before).cast("double"))
    top, low = (F.avg(F.when(F.col("factor_quantile") == k, F.col("fwd"))) for k in (q, 1))
    daily = changed.groupBy(*by).agg((top - low).alias("spread"), F.avg("__new").alias("turned")).join(ic, list(by), "left")
    so_far = Window.partitionBy("name", "horizon").orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)  # a row per date
    daily = daily.withColumn("__wealth", F.exp(F.sum(F.log1p(F.when(F.col("spread") > -1, F.col("spread")))).over(so_far)))
    daily = daily.withColumn("__dd", F.col("__wealth") / F.greatest(F.max("__wealth").over(so_far), F.lit(1.0)) - 1)
    year = F.lit(float(periods)) / F.col("horizon")
    return (
        daily.groupBy("name", "horizon")
        .agg(F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.stddev_pop("ic")).alias("ic_ir"), F.avg("spread").alias("__m"), F.stddev_pop("spread").alias("__s"), F.avg("turned").alias("avg_turnover"), F.min("__dd").alias("max_drawdown"), F.count("spread").alias("n"))
        .select("name", "horizon", "mean_ic", "ic_ir", (F.col("__m") * year).alias("ann_return"), (F.col("__s") * F.sqrt(year)).alias("ann_vol"), (F.try_divide("__m", "__s") * F.sqrt(year)).alias("sharpe"), "avg_turnover", "max_drawdown", "n")
    )


@dataclass(frozen=True)
class Rules:
    """Limits and weights of verdicts (fixed defaults)."""

    cost_rate: float = 0.001
    periods: int = 252
    negative_sign: float = -0.2
    positive_sign: float = 0.2
    strong_ic: float = 0.03
    medium_ic: float = 0.015
    weak_ic: float = 0.005
    high_turnover: float = 0.6
    too_high_turnover: float = 0.8
    min_abs_ic: float = 0.01
    min_abs_ir: float = 0.1
    min_net_sharpe: float = 0.3
    max_turnover: float = 0.8
    max_drawdown: float = 0.5
    weight_ic: float = 4.0
    weight_ir: float = 2.0
    weight_sharpe: float = 3.0
    weight_turnover: float = 2.0
    weight_drawdown: float = 1.0


def with_costs(table: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Yearly cost of turnover, growth and Sharpe ratio after it; no ratio where there is no risk."""
    out = table.withColumn("cost_penalty", F.col("avg_turnover") * rules.cost_rate * rules.periods)
    out = out.withColumn("net_ann_return", F.col("ann_return") - F.col("cost_penalty"))
    return out.withColumn("net_sharpe", F.when(F.col("ann_vol") > 0, F.col("net_ann_return") / F.col("ann_vol")))


def _graded(x: Column, rules: Rules) -> Column:
    return F.when(x > rules.strong_ic, "strong").when(x > rules.medium_ic, "medium").when(x > rules.weak_ic, "weak_but_usable").otherwise("too_weak")


def verdicts(table: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per factor: its direction, quality, tradeability, best horizons, and what to do. Ties go to the shorter horizon."""
    c = F.col
    sharpe = c("net_sharpe") if "net_sharpe" in table.columns else c("sharpe")
    best = lambda x: F.max_by("horizon", F.when(x.isNotNull(), F.struct(F.abs(x), -c("horizon"))))
    out = table.groupBy("name").agg(
        F.avg(F.signum("mean_ic")).alias("sign_score"), F.avg(F.abs("mean_ic")).alias("ic_strength"), F.avg("avg_turnover").alias("turnover"), best(c("mean_ic")).alias("best_ic_horizon"), best(sharpe).alias("best_sharpe_horizon")
    )
    direction = F.when(c("sign_score") < rules.negative_sign, "reverse_factor").when(c("sign_score") > rules.positive_sign, "use_as_is").when(c("sign_score").isNotNull(), "unstable").otherwise("unknown")
    trade = F.when(c("turnover").isNull(), "unknown").when(c("turnover") > rules.too_high_turnover, "too_high_turnover").when(c("turnover") > rules.high_turnover, "high_turnover").otherwise("ok")
    out = out.select("*", direction.alias("direction"), F.when(c("ic_strength").isNull(), "unknown").otherwise(_graded(c("ic_strength"), rules)).alias("quality"), trade.alias("tradeability"))
    out = out.withColumn("usable", ~c("quality").isin("too_weak", "unknown") & ~c("direction").isin("unstable", "unknown"))
    horizon = F.coalesce("best_sharpe_horizon", "best_ic_horizon")
    what = F.when(~c("usable"), "DO NOT USE").otherwise(F.concat(c("direction"), F.lit(", use "), horizon.cast("string"), F.lit("D holding")))
    return out.withColumn("recommendation", what)


def filtered(table: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per factor its best horizon's numbers, the limits they fail, and a weighted score that skips missing terms."""
    c = F.col
    own = c("net_sharpe") if "net_sharpe" in table.columns else c("sharpe")
    row = F.struct("horizon", "mean_ic", "ic_ir", own.alias("best_sharpe"), "avg_turnover", "max_drawdown")
    out = table.groupBy("name").agg(F.avg(F.signum("mean_ic")).alias("sign_score"), F.max_by(row, F.when(own.isNotNull(), F.struct(F.abs(own), -c("horizon")))).alias("r")).select("name", "sign_score", "r.*")
    direction = F.when(c("sign_score") < -0.2, "negative").when(c("sign_score") > 0.2, "positive").otherwise("unstable")
    limits = (
        ("mean_ic", F.abs("mean_ic") < rules.min_abs_ic),
        ("ic_ir", F.abs("ic_ir") < rules.min_abs_ir),
        ("net_sharpe", F.abs("best_sharpe") < rules.min_net_sharpe),
        ("avg_turnover", c("avg_turnover") > rules.max_turnover),
        ("max_drawdown", F.abs("max_drawdown") > rules.max_drawdown),
        ("direction", c("direction") == "unstable"),
    )
    out = out.withColumn("direction", direction).withColumn("failed", F.array_join(F.array_compact(F.array(*(F.when(test, name) for name, test in limits))), ","))
    terms = ((rules.weight_ic * 100, F.abs("mean_ic")), (rules.weight_ir, F.abs("ic_ir")), (rules.weight_sharpe, F.abs("best_sharpe")), (-rules.weight_turnover, c("avg_turnover")), (-rules.weight_drawdown, F.abs("max_drawdown")))
    score = sum((F.coalesce(x * w, F.lit(0.0)) for w, x in terms), F.lit(0.0))
    return out.select("name", "horizon", "mean_ic", "ic_ir", "best_sharpe", "avg_turnover", "max_drawdown", "direction", "failed", (c("failed") == "").alias("usable"), score.alias("score"))


def screened(cards: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Scorecards with the rules they fail: a limit is (">=" or "<=", bound) on a column's absolute value; a missing value passes."""
    fails = [F.when(F.abs(F.col(name)) < bound if sign == ">=" else F.col(name) > bound, name) for name, (sign, bound) in limits.items()]
    out = cards.withColumn("failed", F.array_join(F.array_compact(F.array(*fails)), ","))
    return out.select("*", (F.col("failed") == "").alias("usable"), F.when(F.col("ic_mean") < 0, "reverse_factor").otherwise("use_as_is").alias("direction"))


def summary(cards: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Long table of every metric's rank score between 0 and 1 and the weighted score of a factor.

    Turnover, penalties, drawdowns, costs and risks are better low. Ranks go over all factors, a small table.
    """
    whole = Window.partitionBy(F.lit(1))
    scored = cards
    for name in weights:
        low = any(mark in name for mark in ("turnover", "penalty", "drawdown", "cost", "volatility", "risk"))
        x = F.round(F.col(name) * (-1 if low else 1), 9)
        ties = F.count(x).over(Window.partitionBy(x))
        rank = F.rank().over(whole.orderBy(x.asc_nulls_last())) + (ties - 1) / 2
        n = F.count(x).over(whole)
        scored = scored.withColumn(f"__s_{name}", F.when(x.isNotNull(), F.when(n > 1, (rank - 1) / (n - 1)).otherwise(1.0)))
    have = sum((F.when(F.col(f"__s_{m}").isNotNull(), F.lit(float(w))).otherwise(0.0) for m, w in weights.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(f"__s_{m}") * w, F.lit(0.0)) for m, w in weights.items()), F.lit(0.0))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"__s_{m}").alias("score")) for m in weights)))
    return scored.select("name", F.try_divide(total, have).alias("combined"), rows.alias("__r")).select("name", "combined", "__r.*")


# -- single factors over dates ----------------------------------------------


def signals(data: DataFrame, method: str = "percentile", bound: float = 0.8) -> DataFrame:
    """1 for rows in the top of their date, or with a factor of at least ``bound``, else 0."""
    if method == "threshold":
        hit = F.col("factor") >= bound
    else:
        hit = mean_rank(F.col("factor"), ("date_",)) / F.count("factor").over(Window.partitionBy("date_")) >= bound
    return data.withColumn("signal", F.coalesce(hit, F.lit(False)).cast("int"))


def positions(weights: DataFrame, period: int) -> DataFrame:
    """Mean of the weights of the last ``period`` sessions, to a gross of one: holdings that overlap."""
    from quantloom.operators.align import sessions

    calendar = sessions(weights)
    held = weights.join(calendar, "date_").select("code", "weight", F.explode(F.sequence("k", F.col("k") + period - 1)).alias("k"))
    summed = held.groupBy("k", "code").agg(F.sum("weight").alias("weight")).join(calendar, "k")
    return summed.select("date_", "code", F.try_divide("weight", F.sum(F.abs("weight")).over(Window.partitionBy("date_"))).alias("position"))


def quantile_backtest(data: DataFrame, returns: str, q: int = 5, capital: float = 1e6) -> DataFrame:
    """Long-short return of every date, members of both legs, and the equity it makes."""
    rows = placed(data, q, ("date_",)).where(F.col(returns).isNotNull())
    daily = legs(rows, returns, q, ("date_",)).join(rows.groupBy("date_").agg(F.count(F.when(F.col("factor_quantile") == q, 1)).alias("n_long"), F.count(F.when(F.col("factor_quantile") == 1, 1)).alias("n_short")), "date_")
    so_far = Window.orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)  # a row per date
    return daily.where("spread > -1").select("date_", "spread", "n_long", "n_short", (F.exp(F.sum(F.log1p("spread")).over(so_far)) * capital).alias("equity"))


def against_benchmark(returns: DataFrame, column: str, benchmark: str, periods: int = 252) -> DataFrame:
    """Excess growth, tracking error, information ratio, correlation and beta of one series."""
    x, y = F.col(benchmark), F.col(column)
    rows = returns.where(x.isNotNull() & y.isNotNull())
    a = y - x
    track = F.stddev_pop(a) * float(periods) ** 0.5
    return rows.agg(
        (F.avg(a) * periods).alias("excess"), track.alias("tracking_error"), F.try_divide(F.avg(a) * periods, track).alias("information_ratio"), corr_of(x, y).alias("correlation"), F.try_divide(F.covar_samp(y, x), F.var_samp(x)).alias("beta")
    )


def exposure_over_time(data: DataFrame, window: int = 20) -> DataFrame:
    """Spread of a factor per date, share of codes that have it, and the mean of its means over the last dates."""
    daily = data.groupBy("date_").agg(F.avg("factor").alias("mean"), F.stddev_pop("factor").alias("std"), F.min("factor").alias("low"), F.max("factor").alias("high"), (F.count("factor") / F.count("*")).alias("coverage"))
    w = Window.orderBy("date_").rowsBetween(-(window - 1), 0)  # a row per date
    return daily.withColumn("rolling", F.avg("mean").over(w))


def dynamics(ic: DataFrame, column: str, window: int = 12) -> DataFrame:
    """Mean, deviation and ratio of a coefficient over the last dates; null until the window is full."""
    w = Window.orderBy("date_").rowsBetween(-(window - 1), 0)  # a row per date
    whole = F.count(column).over(w) >= window
    mean, std = F.avg(column).over(w), F.stddev_samp(column).over(w)
    return ic.select("date_", F.when(whole, mean).alias("mean"), F.when(whole, std).alias("std"), F.when(whole, F.try_divide(mean, std)).alias("ir"))


def attribution(returns: DataFrame, factor_return: str, market: str, periods: int = 252) -> DataFrame:
    """What of a factor's mean return is the market's and what its own, with the line's fit and the t value of its height."""
    x, y = F.col(market), F.col(factor_return)
    rows = returns.where(x.isNotNull() & y.isNotNull())
    n, sxx, beta = F.count("*"), F.var_pop(x) * F.count("*"), F.try_divide(F.covar_samp(y, x), F.var_samp(x))
    alpha = F.avg(y) - beta * F.avg(x)
    rest = (F.var_pop(y) - beta * F.covar_pop(y, x)) * n
    error = F.sqrt(rest / (n - 2) * (1 / n + F.avg(x) * F.avg(x) / sxx))
    return rows.agg(n.alias("n"), alias_all(alpha=alpha, beta=beta, t_alpha=F.try_divide(alpha, error), r2=1 - F.try_divide(rest, F.var_pop(y) * n), from_market=beta * F.avg(x) * periods, own=alpha * periods, total=F.avg(y) * periods)).select("n", "__a.*")


def alias_all(**columns: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in columns.items())).alias("__a")


def mean_by_time(ic: DataFrame, column: str, unit: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of a coefficient per period (and group)."""
    return ic.groupBy(F.date_trunc(unit, "date_").cast("date").alias("start"), *by).agg(F.avg(column).alias("mean"), F.count(column).alias("n"))


def rescaled(returns: Column, period: int, base: int = 1) -> Column:
    """Return of ``period`` rows as one of ``base`` rows."""
    return F.pow(1 + returns, base / period) - 1


def rescaled_deviation(std: Column, period: int, base: int = 1) -> Column:
    return std * (base / period) ** 0.5
