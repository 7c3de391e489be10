"""Queries of scorecards, horizons, verdicts and single-factor studies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import evaluation, portfolio, scorecard
from quantloom.plans.panels import DAILY_SQL, MONTHLY_SQL, daily, monthly
from quantloom.plans.research import FACTOR_SQL, IC_SQL, TOP_SQL, WEIGHT_SQL, _corr, factor_data, ic_spearman, query

NAMES = ("momentum", "reversal", "size")

WIDE_SQL = f"""
    SELECT date_, code, industry, volume, close / nullif(lag(close, 3) OVER w, 0) - 1 AS momentum, -ret AS reversal, ln(cap) AS size,
           lead(close, 1) OVER w / nullif(close, 0) - 1 AS fwd_1, lead(close, 3) OVER w / nullif(close, 0) - 1 AS fwd_3,
           CASE WHEN avg(ret) OVER (PARTITION BY date_) > 0 THEN 'up' ELSE 'down' END AS regime
    FROM ({MONTHLY_SQL}) WINDOW w AS (PARTITION BY code ORDER BY date_)
"""
STACK_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, date_, code, industry, volume, fwd_1, fwd_3, regime, {n} AS factor FROM ({WIDE_SQL})" for n in NAMES)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three factors with forward returns, volume, and whether the month was good for most."""
    w = Window.partitionBy("code").orderBy("date_")
    panel = monthly(spark, sf_dir)
    forward = ((F.try_divide(F.lead("close", n).over(w), F.col("close")) - 1).alias(f"fwd_{n}") for n in (1, 3))
    regime = F.when(F.avg("ret").over(Window.partitionBy("date_")) > 0, "up").otherwise("down").alias("regime")
    return panel.select("date_", "code", "industry", "volume", (F.try_divide(F.col("close"), F.lag("close", 3).over(w)) - 1).alias("momentum"), (-F.col("ret")).alias("reversal"), F.log("cap").alias("size"), *forward, regime)


def many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.stacked(wide(spark, sf_dir), NAMES, ["date_", "code", "industry", "volume", "fwd_1", "fwd_3", "regime"])


def rank_sql(x: str, by: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY round({x}, 9) NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, round({x}, 9)) - 1) / 2.0 END"


def placed_sql(sql: str, by: str, q: int = 5) -> str:
    return f"SELECT *, CAST(ceil(row_number() OVER (PARTITION BY {by} ORDER BY round(factor, 9), code) * {q} / CAST(count(*) OVER (PARTITION BY {by}) AS DOUBLE)) AS INTEGER) AS factor_quantile FROM ({sql}) WHERE factor IS NOT NULL"


LEGS = "avg(CASE WHEN factor_quantile = 5 THEN {r} END) AS long, avg(CASE WHEN factor_quantile = 1 THEN {r} END) AS short, avg(CASE WHEN factor_quantile = 5 THEN {r} END) - avg(CASE WHEN factor_quantile = 1 THEN {r} END) AS spread"

SCORE_SQL = f"""
    WITH s AS ({STACK_SQL}), x AS (SELECT *, CASE WHEN fwd_1 IS NOT NULL THEN factor END AS px, CASE WHEN factor IS NOT NULL THEN fwd_1 END AS py FROM s),
    r AS (SELECT *, {rank_sql('px', 'name, date_')} AS rx, {rank_sql('py', 'name, date_')} AS ry, {rank_sql('factor', 'name, date_')} AS r, count(factor) OVER (PARTITION BY name, date_) AS c, {rank_sql('abs(factor)', 'name, date_')} AS ra FROM x),
    m AS (SELECT *, lag(factor) OVER w AS was, lag(r) OVER w AS rwas, abs(r / c - lag(r / c) OVER w) AS move FROM r WINDOW w AS (PARTITION BY name, code ORDER BY date_)),
    d AS (SELECT name, date_, {_corr('px', 'py')} AS ic, {_corr('rx', 'ry')} AS rank_ic, {_corr('factor', 'was')} AS autocorr, {_corr('r', 'rwas')} AS rank_autocorr, avg(move) AS move, min(regime) AS regime, avg(abs(ra / c - 0.5) / (abs(volume) + 1e-6)) AS usage FROM m GROUP BY name, date_),
    l AS (SELECT name, date_, {LEGS.format(r='fwd_1')} FROM ({placed_sql('SELECT * FROM s', 'name, date_')}) GROUP BY name, date_),
    h AS (SELECT d.*, l.spread, row_number() OVER (PARTITION BY d.name ORDER BY d.date_) <= floor(count(*) OVER (PARTITION BY d.name) / 2) AS half FROM d LEFT JOIN l ON d.name = l.name AND d.date_ = l.date_),
    g AS (SELECT name, 1 / (1 + stddev_pop(m)) AS regime_robustness FROM (SELECT name, regime, avg(ic) AS m FROM h GROUP BY name, regime) GROUP BY name),
    a AS (SELECT name, avg(ic) AS ic_mean, avg(ic) / (stddev_pop(ic) + 1e-6) AS ic_ir, avg(rank_ic) AS rank_ic_mean, avg(spread) / stddev_pop(spread) * sqrt(252) AS sharpe, avg(move) AS turnover, 1 / (1 + 5 * avg(move)) AS decay_score, 1 / (1 + avg(usage)) AS capacity_score,
                 1 / (1 + abs(avg(CASE WHEN half THEN ic END) - avg(CASE WHEN NOT half THEN ic END))) AS out_of_sample_stability, avg(autocorr) AS factor_autocorr, avg(rank_autocorr) AS rank_factor_autocorr FROM h GROUP BY name)
    SELECT a.name, ic_mean, ic_ir, rank_ic_mean, sharpe, turnover, decay_score, capacity_score, regime_robustness, out_of_sample_stability, factor_autocorr, rank_factor_autocorr,
           (ic_mean + rank_ic_mean + 0.5 * ic_ir) * decay_score * capacity_score * regime_robustness * out_of_sample_stability / (1 + turnover) AS fitness FROM a JOIN g ON a.name = g.name
"""
SCORES = ("ic_mean", "ic_ir", "rank_ic_mean", "sharpe", "turnover", "decay_score", "capacity_score", "regime_robustness", "out_of_sample_stability", "factor_autocorr", "rank_factor_autocorr", "fitness")


def cards(spark, sf_dir):
    return scorecard.evaluate(many(spark, sf_dir), "fwd_1", usage="volume", regime="regime")


@query(SCORE_SQL, SCORES)
def factor_scorecard(spark, sf_dir):
    return cards(spark, sf_dir)


LIMITS = {"ic_mean": (">=", 0.01), "rank_ic_mean": (">=", 0.01), "sharpe": (">=", 0.5), "turnover": ("<=", 0.2), "fitness": (">=", 0.001)}
_FAILS = ", ".join(f"CASE WHEN {f'abs({n}) < {b}' if s == '>=' else f'{n} > {b}'} THEN '{n}' END" for n, (s, b) in LIMITS.items())


@query(f"WITH c AS ({SCORE_SQL}), f AS (SELECT *, array_to_string(list_filter([{_FAILS}], lambda x: x IS NOT NULL), ',') AS failed FROM c) SELECT *, failed = '' AS usable, CASE WHEN ic_mean < 0 THEN 'reverse_factor' ELSE 'use_as_is' END AS direction FROM f", SCORES)
def factor_screen(spark, sf_dir):
    return scorecard.screened(cards(spark, sf_dir), LIMITS)


WEIGHTS = {"ic_mean": 1.0, "sharpe": 2.0, "turnover": 0.5}


def _score(m: str) -> str:
    x = f"round({m} * {-1 if m == 'turnover' else 1}, 9)"
    return f"CASE WHEN {m} IS NOT NULL THEN (rank() OVER (ORDER BY {x} NULLS LAST) + (count({m}) OVER (PARTITION BY {x}) - 1) / 2.0 - 1) / (count({m}) OVER () - 1) END"


@query(
    f"""WITH c AS ({SCORE_SQL}), s AS (SELECT *, {', '.join(f'{_score(m)} AS s_{m}' for m in WEIGHTS)} FROM c),
        t AS (SELECT *, (s_ic_mean * 1.0 + s_sharpe * 2.0 + s_turnover * 0.5) / 3.5 AS combined FROM s)
        {' UNION ALL '.join(f"SELECT name, combined, '{m}' AS metric, {m} AS value, s_{m} AS score FROM t" for m in WEIGHTS)}""",
    ("combined", "value", "score"),
)
def factor_summary(spark, sf_dir):
    return scorecard.summary(cards(spark, sf_dir), WEIGHTS)


HORIZON_SQL = f"""
    WITH s AS ({STACK_SQL}), l AS (SELECT name, date_, code, factor, 1 AS horizon, fwd_1 AS fwd FROM s UNION ALL SELECT name, date_, code, factor, 3, fwd_3 FROM s),
    x AS (SELECT *, CASE WHEN fwd IS NOT NULL THEN factor END AS px, CASE WHEN factor IS NOT NULL THEN fwd END AS py FROM l),
    r AS (SELECT *, {rank_sql('px', 'name, horizon, date_')} AS rx, {rank_sql('py', 'name, horizon, date_')} AS ry FROM x),
    i AS (SELECT name, horizon, date_, {_corr('rx', 'ry')} AS ic FROM r GROUP BY name, horizon, date_),
    p AS (SELECT *, CAST(factor_quantile <> lag(factor_quantile) OVER (PARTITION BY name, horizon, code ORDER BY date_) AS DOUBLE) AS fresh FROM ({placed_sql('SELECT * FROM l', 'name, horizon, date_')})),
    d AS (SELECT name, horizon, date_, {LEGS.format(r='fwd')}, avg(fresh) AS turned FROM p GROUP BY name, horizon, date_),
    j AS (SELECT d.*, i.ic FROM d LEFT JOIN i ON d.name = i.name AND d.horizon = i.horizon AND d.date_ = i.date_),
    w AS (SELECT *, exp(sum(ln(1 + CASE WHEN spread > -1 THEN spread END)) OVER (PARTITION BY name, horizon ORDER BY date_ ROWS UNBOUNDED PRECEDING)) AS wealth FROM j),
    f AS (SELECT *, wealth / greatest(max(wealth) OVER (PARTITION BY name, horizon ORDER BY date_ ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS dd FROM w)
    SELECT name, CAST(horizon AS INTEGER) AS horizon, avg(ic) AS mean_ic, avg(ic) / stddev_pop(ic) AS ic_ir, avg(spread) * 252 / horizon AS ann_return, stddev_pop(spread) * sqrt(252.0 / horizon) AS ann_vol,
           avg(spread) / stddev_pop(spread) * sqrt(252.0 / horizon) AS sharpe, avg(turned) AS avg_turnover, min(dd) AS max_drawdown, count(spread) AS n FROM f GROUP BY name, horizon
"""
HORIZON_COLUMNS = ("mean_ic", "ic_ir", "ann_return", "ann_vol", "sharpe", "avg_turnover", "max_drawdown")


def horizons(spark, sf_dir):
    return scorecard.horizon_table(many(spark, sf_dir), {1: "fwd_1", 3: "fwd_3"})


@query(HORIZON_SQL, HORIZON_COLUMNS)
def factor_horizons(spark, sf_dir):
    return horizons(spark, sf_dir)


COST_SQL = f"SELECT *, avg_turnover * 0.001 * 252 AS cost_penalty, ann_return - avg_turnover * 0.001 * 252 AS net_ann_return, CASE WHEN ann_vol > 0 THEN (ann_return - avg_turnover * 0.001 * 252) / ann_vol END AS net_sharpe FROM ({HORIZON_SQL})"


@query(COST_SQL, (*HORIZON_COLUMNS, "cost_penalty", "net_ann_return", "net_sharpe"))
def factor_costs(spark, sf_dir):
    return scorecard.with_costs(horizons(spark, sf_dir))


@query(
    f"""WITH a AS (SELECT name, avg(sign(mean_ic)) AS sign_score, avg(abs(mean_ic)) AS ic_strength, avg(avg_turnover) AS turnover, arg_max(horizon, abs(mean_ic)) AS best_ic_horizon, arg_max(horizon, abs(net_sharpe)) AS best_sharpe_horizon FROM ({COST_SQL}) GROUP BY name),
        b AS (SELECT *, CASE WHEN sign_score < -0.2 THEN 'reverse_factor' WHEN sign_score > 0.2 THEN 'use_as_is' ELSE 'unstable' END AS direction, CASE WHEN ic_strength > 0.03 THEN 'strong' WHEN ic_strength > 0.015 THEN 'medium' WHEN ic_strength > 0.005 THEN 'weak_but_usable' ELSE 'too_weak' END AS quality,
                     CASE WHEN turnover > 0.8 THEN 'too_high_turnover' WHEN turnover > 0.6 THEN 'high_turnover' ELSE 'ok' END AS tradeability FROM a),
        c AS (SELECT *, quality <> 'too_weak' AND direction <> 'unstable' AS usable FROM b)
        SELECT *, CASE WHEN NOT usable THEN 'DO NOT USE' ELSE direction || ', use ' || best_sharpe_horizon || 'D holding' END AS recommendation FROM c""",
    ("sign_score", "ic_strength", "turnover"),
)
def factor_verdicts(spark, sf_dir):
    return scorecard.verdicts(scorecard.with_costs(horizons(spark, sf_dir)))


@query(
    f"""WITH a AS (SELECT name, avg(sign(mean_ic)) AS sign_score, arg_max(struct_pack(horizon, mean_ic, ic_ir, net_sharpe, avg_turnover, max_drawdown), abs(net_sharpe)) AS r FROM ({COST_SQL}) GROUP BY name),
        b AS (SELECT name, r.horizon AS horizon, r.mean_ic AS mean_ic, r.ic_ir AS ic_ir, r.net_sharpe AS best_sharpe, r.avg_turnover AS avg_turnover, r.max_drawdown AS max_drawdown, CASE WHEN sign_score < -0.2 THEN 'negative' WHEN sign_score > 0.2 THEN 'positive' ELSE 'unstable' END AS direction FROM a),
        c AS (SELECT *, array_to_string(list_filter([CASE WHEN abs(mean_ic) < 0.01 THEN 'mean_ic' END, CASE WHEN abs(ic_ir) < 0.1 THEN 'ic_ir' END, CASE WHEN abs(best_sharpe) < 0.3 THEN 'net_sharpe' END, CASE WHEN avg_turnover > 0.8 THEN 'avg_turnover' END,
                     CASE WHEN abs(max_drawdown) > 0.5 THEN 'max_drawdown' END, CASE WHEN direction = 'unstable' THEN 'direction' END], lambda x: x IS NOT NULL), ',') AS failed FROM b)
        SELECT *, failed = '' AS usable, coalesce(abs(mean_ic) * 400, 0) + coalesce(abs(ic_ir) * 2, 0) + coalesce(abs(best_sharpe) * 3, 0) - coalesce(avg_turnover * 2, 0) - coalesce(abs(max_drawdown), 0) AS score FROM c""",
    ("mean_ic", "ic_ir", "best_sharpe", "avg_turnover", "max_drawdown", "score"),
)
def factor_filter(spark, sf_dir):
    return scorecard.filtered(scorecard.with_costs(horizons(spark, sf_dir)))


# -- single factors ---------------------------------------------------------


@query(
    f"""SELECT date_, code, factor, CAST(CASE WHEN up THEN 2 ELSE 0 END + ceil(row_number() OVER (PARTITION BY date_, up ORDER BY round(factor, 9), code) * 2 / CAST(count(*) OVER (PARTITION BY date_, up) AS DOUBLE)) AS INTEGER) AS factor_quantile
        FROM (SELECT *, factor >= 0 AS up FROM ({FACTOR_SQL}) WHERE factor IS NOT NULL)""",
    ("factor",),
)
def quantiles_zero_aware(spark, sf_dir):
    return scorecard.zero_aware(factor_data(spark, sf_dir).select("date_", "code", "factor"))


@query(
    f"""SELECT date_, code, CASE WHEN hi > lo THEN CAST(greatest(ceil(round((factor - lo) / (hi - lo) * 4, 9)), 1) AS INTEGER) ELSE 1 END AS factor_quantile
        FROM (SELECT *, min(factor) OVER (PARTITION BY date_) AS lo, max(factor) OVER (PARTITION BY date_) AS hi FROM ({FACTOR_SQL}) WHERE factor IS NOT NULL)"""
)
def quantiles_by_width(spark, sf_dir):
    return scorecard.width_bins(factor_data(spark, sf_dir).select("date_", "code", "factor"), 4).drop("factor")


@query(f"SELECT date_, code, CAST(coalesce({rank_sql('factor', 'date_')} / count(factor) OVER (PARTITION BY date_) >= 0.8, FALSE) AS INTEGER) AS signal FROM ({FACTOR_SQL})")
def signals_percentile(spark, sf_dir):
    return scorecard.signals(factor_data(spark, sf_dir)).select("date_", "code", "signal")


@query(f"SELECT date_, code, CAST(coalesce(factor >= 0.1, FALSE) AS INTEGER) AS signal FROM ({FACTOR_SQL})")
def signals_threshold(spark, sf_dir):
    return scorecard.signals(factor_data(spark, sf_dir), "threshold", 0.1).select("date_", "code", "signal")


@query(
    f"""WITH t AS ({TOP_SQL}), s AS (SELECT date_, row_number() OVER (ORDER BY date_) AS k FROM (SELECT DISTINCT date_ FROM t)), h AS (SELECT t.code, t.weight, s.k + o AS k FROM t JOIN s USING (date_), range(0, 3) r(o)),
        p AS (SELECT k, code, sum(weight) AS weight FROM h GROUP BY k, code) SELECT s.date_, p.code, p.weight / nullif(sum(abs(p.weight)) OVER (PARTITION BY s.date_), 0) AS position FROM p JOIN s ON s.k = p.k""",
    ("position",),
)
def overlapping_positions(spark, sf_dir):
    return scorecard.positions(portfolio.top_weights(factor_data(spark, sf_dir), "factor", 5, short=True), 3)


@query(
    f"""WITH p AS ({placed_sql(FACTOR_SQL, 'date_')}), k AS (SELECT * FROM p WHERE fwd_1 IS NOT NULL),
        d AS (SELECT date_, {LEGS.format(r='fwd_1')}, count(*) FILTER (WHERE factor_quantile = 5) AS n_long, count(*) FILTER (WHERE factor_quantile = 1) AS n_short FROM k GROUP BY date_)
        SELECT date_, spread, n_long, n_short, exp(sum(ln(1 + spread)) OVER (ORDER BY date_ ROWS UNBOUNDED PRECEDING)) * 1e6 AS equity FROM d WHERE spread > -1""",
    ("spread", "equity"),
)
def quantile_backtest(spark, sf_dir):
    return scorecard.quantile_backtest(factor_data(spark, sf_dir), "fwd_1")


PORTFOLIO_SQL = f"SELECT date_, sum(weight * fwd_1) AS factor_return, avg(fwd_1) AS market FROM ({WEIGHT_SQL}) GROUP BY date_"


def portfolio_and_market(spark, sf_dir):
    data = factor_data(spark, sf_dir)
    return evaluation.factor_weights(data, "factor").groupBy("date_").agg(F.sum(F.col("weight") * F.col("fwd_1")).alias("factor_return"), F.avg("fwd_1").alias("market"))


@query(
    f"""SELECT avg(y - x) * 252 AS excess, stddev_pop(y - x) * sqrt(252) AS tracking_error, avg(y - x) * 252 / (stddev_pop(y - x) * sqrt(252)) AS information_ratio, {_corr('x', 'y')} AS correlation, covar_samp(y, x) / var_samp(x) AS beta
        FROM (SELECT market AS x, factor_return AS y FROM ({PORTFOLIO_SQL}) WHERE market IS NOT NULL AND factor_return IS NOT NULL)""",
    ("excess", "tracking_error", "information_ratio", "correlation", "beta"),
)
def benchmark_metrics(spark, sf_dir):
    return scorecard.against_benchmark(portfolio_and_market(spark, sf_dir), "factor_return", "market")


@query(
    f"""WITH f AS (SELECT market AS x, factor_return AS y FROM ({PORTFOLIO_SQL}) WHERE market IS NOT NULL AND factor_return IS NOT NULL), a AS (SELECT count(*) AS n, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, regr_r2(y, x) AS r2, regr_syy(y, x) AS syy, regr_sxx(y, x) AS sxx, avg(x) AS mx, avg(y) AS my FROM f)
        SELECT n, alpha, beta, alpha / sqrt(syy * (1 - r2) / (n - 2) * (1.0 / n + mx * mx / sxx)) AS t_alpha, r2, beta * mx * 252 AS from_market, alpha * 252 AS own, my * 252 AS total FROM a""",
    ("alpha", "beta", "t_alpha", "r2", "from_market", "own", "total"),
)
def factor_attribution(spark, sf_dir):
    return scorecard.attribution(portfolio_and_market(spark, sf_dir), "factor_return", "market")


@query(f"SELECT date_, factor_return, exp(sum(ln(1 + CASE WHEN factor_return > -1 THEN factor_return END)) OVER (ORDER BY date_ ROWS UNBOUNDED PRECEDING)) - 1 AS cumulative FROM ({PORTFOLIO_SQL})", ("factor_return", "cumulative"))
def factor_cumulative(spark, sf_dir):
    so_far = Window.orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)  # a row per date
    r = F.col("factor_return")
    return portfolio_and_market(spark, sf_dir).select("date_", "factor_return", (F.exp(F.sum(F.log1p(F.when(r > -1, r))).over(so_far)) - 1).alias("cumulative"))


@query(f"SELECT date_, factor_quantile, avg(fwd_1) AS mean, stddev_samp(fwd_1) AS std, stddev_samp(fwd_1) / sqrt(count(fwd_1)) AS se, count(fwd_1) AS n FROM ({placed_sql(FACTOR_SQL, 'date_')}) GROUP BY date_, factor_quantile", ("mean", "std", "se"))
def quantile_returns_by_date(spark, sf_dir):
    return evaluation.quantile_returns(evaluation.quantiles(factor_data(spark, sf_dir), "factor", 5), "fwd_1", ("date_", "factor_quantile"))


@query(f"SELECT date_, code, fwd_1 - avg(fwd_1) OVER (PARTITION BY date_, industry) AS fwd_1, fwd_3 - avg(fwd_3) OVER (PARTITION BY date_, industry) AS fwd_3 FROM ({FACTOR_SQL})", ("fwd_1", "fwd_3"))
def forward_returns_demeaned(spark, sf_dir):
    return evaluation.demeaned(factor_data(spark, sf_dir), ["fwd_1", "fwd_3"], ("date_", "industry")).select("date_", "code", "fwd_1", "fwd_3")


@query(f"WITH b AS (SELECT *, lag(factor) OVER (PARTITION BY code ORDER BY date_) AS was FROM ({FACTOR_SQL})) SELECT date_, {_corr('factor', 'was')} AS autocorrelation FROM b GROUP BY date_", ("autocorrelation",))
def factor_autocorrelation(spark, sf_dir):
    w = Window.partitionBy("code").orderBy("date_")
    rows = factor_data(spark, sf_dir).withColumn("was", F.lag("factor").over(w))
    return rows.groupBy("date_").agg(evaluation.corr_of(F.col("factor"), F.col("was")).alias("autocorrelation"))


@query(f"SELECT CAST(date_trunc('year', date_) AS DATE) AS start, avg(ic_fwd_1) AS mean, count(ic_fwd_1) AS n FROM ({IC_SQL}) GROUP BY CAST(date_trunc('year', date_) AS DATE)", ("mean",))
def ic_by_year(spark, sf_dir):
    return scorecard.mean_by_time(ic_spearman(spark, sf_dir), "ic_fwd_1", "year")


@query(
    f"""SELECT date_, CASE WHEN n >= 12 THEN mean END AS mean, CASE WHEN n >= 12 THEN std END AS std, CASE WHEN n >= 12 THEN mean / nullif(std, 0) END AS ir
        FROM (SELECT date_, count(ic_fwd_1) OVER w AS n, avg(ic_fwd_1) OVER w AS mean, stddev_samp(ic_fwd_1) OVER w AS std FROM ({IC_SQL}) WINDOW w AS (ORDER BY date_ ROWS 11 PRECEDING))""",
    ("mean", "std", "ir"),
)
def ic_dynamics(spark, sf_dir):
    return scorecard.dynamics(ic_spearman(spark, sf_dir), "ic_fwd_1")


@query(
    f"""WITH d AS (SELECT date_, avg(factor) AS mean, stddev_pop(factor) AS std, min(factor) AS low, max(factor) AS high, count(factor) / CAST(count(*) AS DOUBLE) AS coverage FROM ({FACTOR_SQL}) GROUP BY date_)
        SELECT *, avg(mean) OVER (ORDER BY date_ ROWS 19 PRECEDING) AS rolling FROM d""",
    ("mean", "std", "low", "high", "coverage", "rolling"),
)
def factor_exposure(spark, sf_dir):
    return scorecard.exposure_over_time(factor_data(spark, sf_dir))


@query(f"SELECT date_, code, pow(1 + fwd_3, 1 / 3.0) - 1 AS per_row FROM ({FACTOR_SQL}) WHERE fwd_3 > -1", ("per_row",))
def returns_rescaled(spark, sf_dir):
    return factor_data(spark, sf_dir).where("fwd_3 > -1").select("date_", "code", scorecard.rescaled(F.col("fwd_3"), 3).alias("per_row"))


@query(f"SELECT code, stddev_samp(ret) AS std, stddev_samp(ret) * sqrt(1 / 5.0) AS per_row FROM ({DAILY_SQL}) GROUP BY code", ("std", "per_row"))
def deviations_rescaled(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("code").agg(F.stddev_samp("ret").alias("std")).select("code", "std", scorecard.rescaled_deviation(F.col("std"), 5).alias("per_row"))
