"""Queries of alignment, evaluation, portfolios, inference and preparation, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import align, analytics, evaluation, inference, portfolio, prepare
from quantloom.plans.factors import shown, shown_sql
from quantloom.plans.panels import DAILY_SQL, MONTHLY_SQL, daily, monthly, table
from quantloom.streaming.bars import bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, numbers: tuple[str, ...] = ()):
    """Register a query; columns named in ``numbers`` are shown in single precision on both sides."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: shown(F.col(c)) for c in numbers}) if numbers else f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            shown_list = ", ".join(f"{shown_sql(c)} AS {c}" for c in numbers)
            ORACLE[f.__name__] = f"SELECT * REPLACE ({shown_list}) FROM ({sql})" if numbers else sql
        return f

    return add


FACTOR_SQL = f"""
    SELECT date_, code, industry, close, close / nullif(lag(close, 3) OVER (PARTITION BY code ORDER BY date_), 0) - 1 AS factor,
           lead(close, 1) OVER (PARTITION BY code ORDER BY date_) / nullif(close, 0) - 1 AS fwd_1,
           lead(close, 3) OVER (PARTITION BY code ORDER BY date_) / nullif(close, 0) - 1 AS fwd_3
    FROM ({MONTHLY_SQL})
"""


def factor_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-month momentum with forward returns, monthly."""
    panel = monthly(spark, sf_dir)
    w = Window.partitionBy("code").orderBy("date_")
    own = panel.select("date_", "code", "industry", "close", (F.try_divide(F.col("close"), F.lag("close", 3).over(w)) - 1).alias("factor"))
    return own.select("*", *((F.try_divide(F.lead("close", n).over(w), F.col("close")) - 1).alias(f"fwd_{n}") for n in (1, 3)))


def _corr(x: str, y: str, least: int = 3) -> str:
    px, py = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"CASE WHEN count({px}) >= {least} AND stddev_samp({px}) > 1e-9 AND stddev_samp({py}) > 1e-9 THEN covar_samp({px}, {py}) / (stddev_samp({px}) * stddev_samp({py})) END"


@query(f"SELECT date_, code, fwd_1, fwd_3 FROM ({FACTOR_SQL})", ("fwd_1", "fwd_3"))
def forward_returns(spark, sf_dir):
    return evaluation.forward_returns(monthly(spark, sf_dir), [1, 3])


@query(f"SELECT date_, {_corr('factor', 'fwd_1')} AS ic_fwd_1, {_corr('factor', 'fwd_3')} AS ic_fwd_3 FROM ({FACTOR_SQL}) GROUP BY date_", ("ic_fwd_1", "ic_fwd_3"))
def ic_pearson(spark, sf_dir):
    return evaluation.information_coefficient(factor_data(spark, sf_dir), "factor", ["fwd_1", "fwd_3"], "pearson")


def _ranked(sql: str, by: str) -> str:
    rank = lambda c: f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY round({c}, 9) NULLS LAST) + (count({c}) OVER (PARTITION BY {by}, round({c}, 9)) - 1) / 2.0 END"
    return f"SELECT {by}, {rank('x')} AS x, {rank('y')} AS y FROM (SELECT {by}, CASE WHEN fwd_1 IS NOT NULL THEN factor END AS x, CASE WHEN factor IS NOT NULL THEN fwd_1 END AS y FROM ({sql}))"


IC_SQL = f"SELECT date_, {_corr('x', 'y')} AS ic_fwd_1 FROM ({_ranked(FACTOR_SQL, 'date_')}) GROUP BY date_"


@query(IC_SQL, ("ic_fwd_1",))
def ic_spearman(spark, sf_dir):
    return evaluation.information_coefficient(factor_data(spark, sf_dir), "factor", ["fwd_1"])


@query(f"SELECT date_, industry, {_corr('x', 'y')} AS ic_fwd_1 FROM ({_ranked(FACTOR_SQL, 'date_, industry')}) GROUP BY date_, industry", ("ic_fwd_1",))
def ic_by_group(spark, sf_dir):
    return evaluation.information_coefficient(factor_data(spark, sf_dir), "factor", ["fwd_1"], by=("date_", "industry"))


@query(
    f"""SELECT count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / nullif(stddev_samp(ic), 0) AS ir, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)) AS t,
        avg(CAST(ic > 0 AS DOUBLE)) AS positive, avg(CAST(abs(ic) > 0.02 AS DOUBLE)) AS effective FROM (SELECT ic_fwd_1 AS ic FROM ({IC_SQL}))""",
    ("mean", "std", "ir", "t", "positive", "effective"),
)
def ic_summary(spark, sf_dir):
    return evaluation.ic_summary(ic_spearman(spark, sf_dir), "ic_fwd_1")


QUANTILE_SQL = f"""
    SELECT *, CAST(ceil(row_number() OVER (PARTITION BY date_ ORDER BY round(factor, 9), code) * 5 / CAST(count(*) OVER (PARTITION BY date_) AS DOUBLE)) AS INTEGER) AS factor_quantile
    FROM ({FACTOR_SQL}) WHERE factor IS NOT NULL
"""


def quantile_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.quantiles(factor_data(spark, sf_dir), "factor", 5)


@query(f"SELECT date_, code, factor, fwd_1, factor_quantile FROM ({QUANTILE_SQL})", ("factor", "fwd_1"))
def clean_factor(spark, sf_dir):
    return quantile_data(spark, sf_dir).select("date_", "code", "factor", "fwd_1", "factor_quantile")


@query(f"SELECT factor_quantile, avg(fwd_1) AS mean, stddev_samp(fwd_1) AS std, stddev_samp(fwd_1) / sqrt(count(fwd_1)) AS se, count(fwd_1) AS n FROM ({QUANTILE_SQL}) GROUP BY factor_quantile", ("mean", "std", "se"))
def quantile_returns(spark, sf_dir):
    return evaluation.quantile_returns(quantile_data(spark, sf_dir), "fwd_1")


@query(f"SELECT date_, avg(CASE WHEN factor_quantile = 5 THEN fwd_1 END) - avg(CASE WHEN factor_quantile = 1 THEN fwd_1 END) AS spread FROM ({QUANTILE_SQL}) GROUP BY date_", ("spread",))
def quantile_spread(spark, sf_dir):
    return evaluation.spread(quantile_data(spark, sf_dir), "fwd_1", 5)


@query(
    f"""WITH q AS ({QUANTILE_SQL}), s AS (SELECT date_, row_number() OVER (ORDER BY date_) AS k FROM (SELECT DISTINCT date_ FROM q)), h AS (SELECT q.*, s.k FROM q JOIN s USING (date_))
        SELECT h.date_, h.factor_quantile, 1 - count(b.code) / CAST(count(*) AS DOUBLE) AS turnover
        FROM h LEFT JOIN h b ON b.k = h.k - 1 AND b.code = h.code AND b.factor_quantile = h.factor_quantile WHERE h.k > 1 GROUP BY h.date_, h.factor_quantile""",
    ("turnover",),
)
def quantile_turnover(spark, sf_dir):
    return evaluation.turnover(quantile_data(spark, sf_dir))


@query(
    f"""WITH r AS (SELECT date_, code, CASE WHEN factor IS NOT NULL THEN rank() OVER (PARTITION BY date_ ORDER BY round(factor, 9) NULLS LAST) + (count(factor) OVER (PARTITION BY date_, round(factor, 9)) - 1) / 2.0 END AS r FROM ({FACTOR_SQL})),
        b AS (SELECT *, lag(r) OVER (PARTITION BY code ORDER BY date_) AS before FROM r)
        SELECT date_, {_corr('r', 'before')} AS autocorrelation FROM b GROUP BY date_""",
    ("autocorrelation",),
)
def rank_autocorrelation(spark, sf_dir):
    return evaluation.rank_autocorrelation(factor_data(spark, sf_dir), "factor")


WEIGHT_SQL = f"SELECT *, x / nullif(sum(abs(x)) OVER (PARTITION BY date_), 0) AS weight FROM (SELECT *, factor - avg(factor) OVER (PARTITION BY date_) AS x FROM ({FACTOR_SQL}))"


@query(f"SELECT date_, sum(weight * fwd_1) AS factor_return FROM ({WEIGHT_SQL}) GROUP BY date_", ("factor_return",))
def factor_returns(spark, sf_dir):
    return evaluation.factor_returns(factor_data(spark, sf_dir), "factor", "fwd_1")


@query(
    f"""WITH f AS (SELECT date_, sum(weight * fwd_1) AS y, avg(fwd_1) AS x FROM ({WEIGHT_SQL}) GROUP BY date_)
        SELECT covar_samp(y, x) / var_samp(x) AS beta, avg(y) - covar_samp(y, x) / var_samp(x) * avg(x) AS alpha, count(*) AS n FROM f WHERE x IS NOT NULL AND y IS NOT NULL""",
    ("beta", "alpha"),
)
def factor_alpha_beta(spark, sf_dir):
    return evaluation.alpha_beta(factor_data(spark, sf_dir), "factor", "fwd_1")


TOP_SQL = f"""
    SELECT date_, code, side / count(*) OVER (PARTITION BY date_, side) AS weight FROM (
        SELECT *, CASE WHEN b <= 5 THEN 1.0::DOUBLE WHEN w <= 5 THEN -1.0::DOUBLE END AS side FROM (
            SELECT *, row_number() OVER (PARTITION BY date_ ORDER BY round(factor, 9) DESC NULLS LAST, code) AS b, row_number() OVER (PARTITION BY date_ ORDER BY round(factor, 9) NULLS LAST, code) AS w
            FROM ({FACTOR_SQL}) WHERE factor IS NOT NULL)) WHERE side IS NOT NULL
"""


@query(TOP_SQL, ("weight",))
def long_short_weights(spark, sf_dir):
    return portfolio.top_weights(factor_data(spark, sf_dir), "factor", 5, short=True)


TRADES_SQL = f"""
    WITH t AS ({TOP_SQL}), s AS (SELECT date_, row_number() OVER (ORDER BY date_) AS k FROM (SELECT DISTINCT date_ FROM t)), h AS (SELECT t.*, s.k FROM t JOIN s USING (date_))
    SELECT s.date_, coalesce(h.code, b.code) AS code, coalesce(h.weight, 0) - coalesce(b.weight, 0) AS trade
    FROM h FULL JOIN (SELECT k + 1 AS k, code, weight FROM h) b ON h.k = b.k AND h.code = b.code JOIN s ON s.k = coalesce(h.k, b.k)
"""


@query(TRADES_SQL, ("trade",))
def rebalance_trades(spark, sf_dir):
    return portfolio.trades(portfolio.top_weights(factor_data(spark, sf_dir), "factor", 5, short=True))


@query(
    f"""WITH w AS ({TOP_SQL}), g AS (SELECT w.date_, sum(weight * coalesce(fwd_1, 0)) AS gross FROM w LEFT JOIN ({FACTOR_SQL}) f ON f.date_ = w.date_ AND f.code = w.code GROUP BY w.date_),
        t AS (SELECT date_, sum(abs(trade)) AS turnover FROM ({TRADES_SQL}) GROUP BY date_), n AS (SELECT g.date_, gross, turnover, gross - 0.001 * turnover AS net FROM g JOIN t ON g.date_ = t.date_)
        SELECT date_, gross, turnover, net, CASE WHEN net > -1 THEN exp(sum(ln(1 + CASE WHEN net > -1 THEN net END)) OVER (ORDER BY date_ ROWS UNBOUNDED PRECEDING)) END AS equity FROM n""",
    ("gross", "turnover", "net", "equity"),
)
def backtest_long_short(spark, sf_dir):
    data = factor_data(spark, sf_dir)
    return portfolio.backtest(portfolio.top_weights(data, "factor", 5, short=True), data.select("date_", "code", "fwd_1"), "fwd_1", 0.001)


@query(
    f"""WITH r AS (SELECT * FROM ({DAILY_SQL}) WHERE ret > -1), a AS (
        SELECT code, count(ret) AS n, exp(sum(ln(1 + ret))) - 1 AS total, stddev_samp(ret) * sqrt(252) AS volatility, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe,
               avg(ret) / sqrt(sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) / count(ret)) * sqrt(252) AS sortino, avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt(252) AS sortino_losses,
               avg(CAST(ret > 0 AS DOUBLE)) AS win_rate, avg(CASE WHEN ret > 0 THEN ret END) / -avg(CASE WHEN ret < 0 THEN ret END) AS payoff,
               sum(CASE WHEN ret > 0 THEN ret END) / -sum(CASE WHEN ret < 0 THEN ret END) AS profit_factor, max(ret) AS best, min(ret) AS worst, quantile_cont(ret, 0.05) AS var_95
        FROM r GROUP BY code) SELECT *, pow(1 + total, 252.0 / n) - 1 AS cagr FROM a""",
    ("total", "cagr", "volatility", "sharpe", "sortino", "sortino_losses", "win_rate", "payoff", "profit_factor", "best", "worst", "var_95"),
)
def return_analytics(spark, sf_dir):
    return portfolio.performance(daily(spark, sf_dir), "ret", ["code"])


@query(
    f"""WITH w AS (SELECT code, date_, exp(sum(ln(1 + ret)) OVER (PARTITION BY code ORDER BY date_ ROWS UNBOUNDED PRECEDING)) AS wealth FROM ({DAILY_SQL}) WHERE ret > -1)
        SELECT code, date_, wealth / greatest(max(wealth) OVER (PARTITION BY code ORDER BY date_ ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS drawdown FROM w""",
    ("drawdown",),
)
def return_drawdowns(spark, sf_dir):
    return portfolio.drawdowns(daily(spark, sf_dir), "ret").select("code", "date_", "drawdown")


@query(
    f"SELECT code, CAST(date_trunc('month', date_) AS DATE) AS month, exp(sum(ln(1 + CASE WHEN ret > -1 THEN ret END))) - 1 AS compounded, max_by(ret, date_) AS last, sum(ret) AS total FROM ({DAILY_SQL}) GROUP BY code, CAST(date_trunc('month', date_) AS DATE)",
    ("compounded", "last", "total"),
)
def resample_month(spark, sf_dir):
    return portfolio.resample_month(daily(spark, sf_dir), "ret")


@query(
    f"""WITH p AS ({DAILY_SQL}), d AS (SELECT DISTINCT date_ FROM p), c AS (SELECT DISTINCT code FROM p)
        SELECT d.date_, c.code, last_value(p.close IGNORE NULLS) OVER (PARTITION BY c.code ORDER BY d.date_ ROWS UNBOUNDED PRECEDING) AS close FROM d CROSS JOIN c LEFT JOIN p ON p.date_ = d.date_ AND p.code = c.code""",
    ("close",),
)
def dense_panel_filled(spark, sf_dir):
    base = align.dense(daily(spark, sf_dir).select("date_", "code", "close"))
    w = Window.partitionBy("code").orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)
    return base.select("date_", "code", F.last("close", True).over(w).alias("close"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per order priority: orders of status F, their price known from the order's day on."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.select(F.col("o_orderpriority").alias("code"), F.to_date("o_orderdate").alias("date_"), F.col("o_totalprice").cast("double").alias("filed"), "o_orderkey")


@query(
    f"""WITH p AS (SELECT date_, code FROM ({DAILY_SQL})), s AS (SELECT date_, row_number() OVER (ORDER BY date_) AS k FROM (SELECT DISTINCT date_ FROM p)),
        e AS (SELECT o_orderpriority AS code, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DOUBLE) AS filed, o_orderkey FROM orders WHERE o_orderstatus = 'F'),
        x AS (SELECT e.code, s.k + 1 AS k, max_by(filed, (e.d, o_orderkey)) AS filed FROM e JOIN s ON s.date_ = e.d GROUP BY e.code, s.k + 1)
        SELECT p.date_, p.code, (SELECT max_by(x.filed, x.k) FROM x WHERE x.code = p.code AND x.k <= s.k) AS filed FROM p JOIN s ON s.date_ = p.date_""",
    ("filed",),
)
def asof_point_in_time(spark, sf_dir):
    panel = daily(spark, sf_dir).select("date_", "code")
    return align.asof(panel, filings(spark, sf_dir), ["filed"], lag=1, order=["o_orderkey"])


@query(
    f"""WITH d AS (SELECT DISTINCT date_ FROM ({DAILY_SQL})), r AS (SELECT DISTINCT CAST(date_trunc('month', date_) AS DATE) AS r FROM d)
        SELECT p.date_, p.code, max(r.r) AS rebalance, any_value(p.ret) AS ret FROM ({DAILY_SQL}) p JOIN r ON r.r < p.date_ GROUP BY p.date_, p.code""",
    ("ret",),
)
def holding_periods(spark, sf_dir):
    panel = daily(spark, sf_dir).select("date_", "code", "ret")
    marks = panel.select(F.trunc("date_", "month").alias("date_")).distinct()
    return align.holding(panel, marks)


@query("SELECT s_suppkey, s_nationkey, n_name AS nation__n_name, r_name AS region__r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def merge_static(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation__n_name"), "n_regionkey")
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region__r_name"))
    return s.join(n, "s_nationkey", "left").join(r, "n_regionkey", "left").drop("n_regionkey")


@query(
    """WITH a AS (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DOUBLE)) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), b AS (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DOUBLE)) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
       SELECT coalesce(a.k, b.k) AS k, a.v AS done__v, b.v AS open__v FROM a FULL JOIN b ON a.k = b.k""",
    ("done__v", "open__v"),
)
def merge_full_outer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("p"))
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy("k").agg(F.sum("p").alias("v"))
    return align.merge_by_keys({"done": side("F"), "open": side("O")}, ["k"], "full")


@query("SELECT c_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def dedupe_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return align.dedupe_last(o, ["c_custkey"], ["o_orderdate", "o_orderkey"]).join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def screen_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(f"SELECT date_, code, close FROM ({MONTHLY_SQL}) WHERE code IN (SELECT code FROM ({MONTHLY_SQL}) GROUP BY code HAVING max(close) > 400000)", ("close",))
def screen_semi_join(spark, sf_dir):
    panel = monthly(spark, sf_dir)
    passed = panel.groupBy("code").agg(F.max("close").alias("m")).where("m > 400000").select("code")
    return panel.select("date_", "code", "close").join(passed, "code", "left_semi")


@query(
    """WITH c AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS w FROM events GROUP BY user_id, event_type), t AS (SELECT *, sum(w) OVER (PARTITION BY user_id) AS total FROM c)
       SELECT user_id, -sum(w / total * ln(w / total)) AS entropy, CASE WHEN count(*) > 1 THEN -sum(w / total * ln(w / total)) / ln(count(*)) ELSE 0 END AS normalized, count(*) AS topics FROM t GROUP BY user_id""",
    ("entropy", "normalized"),
)
def topic_entropy(spark, sf_dir):
    return inference.entropy(table(spark, sf_dir, "events"), "user_id", "event_type")


STATE_SQL = f"SELECT date_, code, CASE WHEN ret < -0.2 THEN 'bear' WHEN ret > 0.2 THEN 'bull' WHEN ret IS NOT NULL THEN 'flat' END AS state FROM ({DAILY_SQL})"


@query(
    f"""WITH p AS (SELECT lag(state) OVER (PARTITION BY code ORDER BY date_) AS before, state FROM ({STATE_SQL}) WHERE state IS NOT NULL), c AS (SELECT before, state, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY before, state)
        SELECT *, n / CAST(sum(n) OVER (PARTITION BY before) AS DOUBLE) AS share FROM c""",
    ("share",),
)
def market_state_transitions(spark, sf_dir):
    return inference.transitions(inference.market_states(daily(spark, sf_dir), "ret", -0.2, 0.2))


@query(
    f"""WITH i AS ({IC_SQL}), y AS (SELECT year(date_) AS year, avg(ic_fwd_1) AS mean, count(ic_fwd_1) AS n FROM i GROUP BY year(date_))
        SELECT CAST(year AS INTEGER) AS year, mean, n, CAST(sign(mean) = sign((SELECT avg(ic_fwd_1) FROM i)) AS INTEGER) AS agrees FROM y""",
    ("mean",),
)
def ic_stability(spark, sf_dir):
    return inference.stability(ic_spearman(spark, sf_dir), "ic_fwd_1")


P_SQL = f"SELECT industry AS name, 1 / (1 + abs(avg(ic_fwd_1) / stddev_samp(ic_fwd_1) * sqrt(count(ic_fwd_1)))) AS p FROM ({ORACLE['ic_by_group']}) GROUP BY industry"


@query(
    f"""WITH t AS ({P_SQL}), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, name) AS k FROM t)
        SELECT name, p, least(p * m, 1) AS bonferroni, least(max(p * (m - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS holm, least(min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1) AS fdr FROM r""",
    ("p", "bonferroni", "holm", "fdr"),
)
def multiple_testing(spark, sf_dir):
    ic = QUERIES["ic_by_group"](spark, sf_dir)
    x = F.col("ic_fwd_1")
    t = F.avg(x) / F.stddev_samp(x) * F.sqrt(F.count(x))
    tests = ic.groupBy(F.col("industry").alias("name")).agg((1 / (1 + F.abs(t))).alias("p"))
    return inference.corrections(tests)


@query(
    f"""WITH w AS (SELECT {_corr('factor', 'fwd_1')} AS a, {_corr('factor', 'fwd_3')} AS b, {_corr('fwd_1', 'fwd_3')} AS c FROM ({FACTOR_SQL}))
        SELECT 'factor' AS a, 'fwd_1' AS b, a AS corr FROM w UNION ALL SELECT 'factor', 'fwd_3', b FROM w UNION ALL SELECT 'fwd_1', 'fwd_3', c FROM w""",
    ("corr",),
)
def factor_correlations(spark, sf_dir):
    return inference.correlations(factor_data(spark, sf_dir), ["factor", "fwd_1", "fwd_3"])


@query(f"SELECT date_, code, coalesce(factor, avg(factor) OVER (PARTITION BY date_)) AS factor FROM ({FACTOR_SQL})", ("factor",))
def impute_mean(spark, sf_dir):
    return prepare.impute(factor_data(spark, sf_dir).select("date_", "code", "factor"), "factor", "mean")


@query(
    f"""WITH q AS (SELECT date_, code, close, quantile_cont(close, 0.25) OVER (PARTITION BY date_) AS a, quantile_cont(close, 0.75) OVER (PARTITION BY date_) AS b FROM ({MONTHLY_SQL}))
        SELECT date_, code, CAST(close < a - 0.5 * (b - a) OR close > b + 0.5 * (b - a) AS INTEGER) AS outlier FROM q"""
)
def outliers_iqr(spark, sf_dir):
    return prepare.outliers(monthly(spark, sf_dir).select("date_", "code", "close"), "close", "iqr", 0.5).drop("close")


@query(
    f"""WITH q AS (SELECT date_, code, close, min(close) OVER (PARTITION BY date_) AS a, max(close) OVER (PARTITION BY date_) AS b FROM ({MONTHLY_SQL}))
        SELECT date_, code, CASE WHEN b > a THEN CAST(greatest(ceil(round((close - a) / (b - a) * 4, 9)) - 1, 0) AS INTEGER) END AS bin FROM q"""
)
def bin_equal_width(spark, sf_dir):
    return prepare.bin_width(monthly(spark, sf_dir).select("date_", "code", "close"), "close", 4).drop("close")


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment_id FROM customer")
def encode_labels(spark, sf_dir):
    return prepare.label_encode(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").drop("c_mktsegment")


@query("SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment) AS c_mktsegment_n FROM customer")
def encode_frequency(spark, sf_dir):
    return prepare.frequency_encode(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").drop("c_mktsegment")


@query("SELECT date_, code FROM (SELECT CAST(o_orderdate AS DATE) AS date_, o_orderpriority AS code FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT CAST(o_orderdate AS DATE), o_orderpriority FROM orders WHERE o_orderstatus = 'O')")
def axis_intersection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date_"), F.col("o_orderpriority").alias("code"), "o_orderstatus")
    side = lambda s: o.where(F.col("o_orderstatus") == s).select("date_", "code")
    return side("F").intersect(side("O"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS DOUBLE)) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", ("quantity",))
def cube_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("double")).alias("quantity"))


@query("SELECT l_suppkey, sum(CAST(l_quantity AS DOUBLE) * CAST(l_extendedprice AS DOUBLE)) / nullif(sum(CAST(l_quantity AS DOUBLE)), 0) AS price FROM lineitem GROUP BY l_suppkey", ("price",))
def weighted_mean(spark, sf_dir):
    q, p = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.try_divide(F.sum(q * p), F.sum(q)).alias("price"))


@query(
    """SELECT event_type AS code, time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start, min_by(CAST(value AS DOUBLE), (ts, event_id)) AS open, max(CAST(value AS DOUBLE)) AS high, min(CAST(value AS DOUBLE)) AS low,
              max_by(CAST(value AS DOUBLE), (ts, event_id)) AS close, count(*) AS volume, count(*) AS n FROM events GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP))""",
    ("open", "high", "low", "close"),
)
def hourly_bars(spark, sf_dir):
    ticks = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("price"), F.lit(1).alias("size"), F.col("event_id").alias("seq"))
    out = bars(ticks, "1 hour", code="event_type")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


WEALTH_SQL = f"""
    SELECT *, wealth / greatest(max(wealth) OVER (PARTITION BY code ORDER BY date_ ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS dd, quantile_cont(ret, 0.05) OVER (PARTITION BY code) AS low
    FROM (SELECT code, date_, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY code ORDER BY date_ ROWS UNBOUNDED PRECEDING)) AS wealth FROM ({DAILY_SQL}) WHERE ret > -1)
"""


@query(
    f"""WITH a AS (
        SELECT code, count(ret) AS n, exp(avg(ln(1 + ret))) - 1 AS geometric_mean, avg(CAST(ret <> 0 AS DOUBLE)) AS exposure, avg(CASE WHEN ret > 0 THEN ret END) AS avg_win, avg(CASE WHEN ret < 0 THEN ret END) AS avg_loss,
               avg(CAST(ret > 0 AS DOUBLE)) AS win_rate, abs(quantile_cont(ret, 0.95) / quantile_cont(ret, 0.05)) AS tail_ratio, sum(CASE WHEN ret > 0 THEN ret END) / -sum(CASE WHEN ret < 0 THEN ret END) AS omega,
               sum(ret) / -sum(CASE WHEN ret < 0 THEN ret END) AS gain_to_pain, avg(ret) - 1.6448536269514722 * stddev_samp(ret) AS value_at_risk, avg(CASE WHEN ret <= low THEN ret END) AS shortfall,
               skewness(ret) AS skew, kurtosis(ret) AS kurtosis, quantile_cont(ret, 0.99) / avg(CASE WHEN ret >= 0 THEN ret END) AS outlier_win, quantile_cont(ret, 0.01) / avg(CASE WHEN ret < 0 THEN ret END) AS outlier_loss,
               min(dd) AS max_drawdown, pow(exp(sum(ln(1 + ret))), 252.0 / count(ret)) - 1 AS cagr, sum(ret) / abs(min(dd)) AS recovery, sqrt(sum(dd * dd) / (count(ret) - 1)) AS ulcer, avg(ret) / stddev_samp(ret) AS risk_return
        FROM ({WEALTH_SQL}) GROUP BY code)
        SELECT * EXCLUDE (cagr), omega * tail_ratio AS common_sense, omega * win_rate * (avg_win / -avg_loss) AS cpc_index, ((avg_win / -avg_loss) * win_rate - (1 - win_rate)) / (avg_win / -avg_loss) AS kelly, cagr / abs(max_drawdown) AS calmar FROM a""",
    ("geometric_mean", "exposure", "avg_win", "avg_loss", "win_rate", "tail_ratio", "omega", "gain_to_pain", "common_sense", "cpc_index", "kelly", "value_at_risk", "shortfall", "skew", "kurtosis", "outlier_win", "outlier_loss", "max_drawdown", "calmar", "recovery", "ulcer", "risk_return"),
)
def return_tear_sheet(spark, sf_dir):
    return analytics.tear_sheet(daily(spark, sf_dir), "ret")


@query(
    f"""WITH r AS (SELECT code, date_, CAST(sign(ret) AS INTEGER) AS s FROM ({DAILY_SQL}) WHERE ret IS NOT NULL),
        p AS (SELECT code, s, row_number() OVER (PARTITION BY code ORDER BY date_) - row_number() OVER (PARTITION BY code, s ORDER BY date_) AS run FROM r), n AS (SELECT code, s, run, count(*) AS n FROM p GROUP BY code, s, run)
        SELECT code, coalesce(max(CASE WHEN s = 1 THEN n END), 0) AS wins, coalesce(max(CASE WHEN s = -1 THEN n END), 0) AS losses FROM n GROUP BY code"""
)
def return_streaks(spark, sf_dir):
    return analytics.streaks(daily(spark, sf_dir), "ret")


@query(
    f"""WITH d AS (SELECT code, date_, dd, sum(CAST(dd >= 0 AS INTEGER)) OVER (PARTITION BY code ORDER BY date_ ROWS UNBOUNDED PRECEDING) AS spell FROM ({WEALTH_SQL}))
        SELECT code, min(date_) AS start, max(date_) AS "end", count(*) AS n, min(dd) AS deepest FROM d WHERE dd < 0 GROUP BY code, spell""",
    ("deepest",),
)
def drawdown_spells(spark, sf_dir):
    return analytics.drawdown_spells(portfolio.drawdowns(daily(spark, sf_dir), "ret")).drop("valley")


@query(
    f"""WITH p AS (SELECT code, ret AS y, avg(ret) OVER (PARTITION BY date_) AS x FROM ({DAILY_SQL}))
        SELECT code, covar_samp(y, x) / var_samp(x) AS beta, (avg(y) - covar_samp(y, x) / var_samp(x) * avg(x)) * 252 AS alpha, pow(covar_samp(y, x) / (stddev_samp(x) * stddev_samp(y)), 2) AS r2,
               avg(y - x) / stddev_samp(y - x) AS information, avg(y) * 252 / (covar_samp(y, x) / var_samp(x)) AS treynor FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY code""",
    ("beta", "alpha", "r2", "information", "treynor"),
)
def return_benchmark(spark, sf_dir):
    panel = daily(spark, sf_dir).withColumn("market", F.avg("ret").over(Window.partitionBy("date_")))
    return analytics.against(panel, "ret", "market")


@query(
    f"""WITH p AS (SELECT code, ret AS y, lag(ret) OVER (PARTITION BY code ORDER BY date_) AS x FROM ({DAILY_SQL})),
        r AS (SELECT code, abs(covar_samp(y, x) / (stddev_samp(x) * stddev_samp(y))) AS r, count(*) + 1 AS n FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY code)
        SELECT r.code, sqrt(1 + 2 * (SELECT sum((r.n - k) / CAST(r.n AS DOUBLE) * pow(r.r, k)) FROM range(1, 60000) t(k) WHERE k < r.n)) AS penalty FROM r""",
    ("penalty",),
)
def return_autocorrelation_penalty(spark, sf_dir):
    return analytics.autocorrelation_penalty(daily(spark, sf_dir), "ret")


@query(
    f"""WITH q AS ({QUANTILE_SQL}), p AS (SELECT date_, code, ret FROM ({MONTHLY_SQL})), s AS (SELECT date_, row_number() OVER (ORDER BY date_) AS k FROM (SELECT DISTINCT date_ FROM p)),
        e AS (SELECT q.code, s.k, q.factor_quantile FROM q JOIN s USING (date_)), r AS (SELECT p.code, s.k, p.ret FROM p JOIN s USING (date_))
        SELECT factor_quantile, CAST(o AS INTEGER) AS "offset", avg(ret) AS mean, stddev_samp(ret) AS std, count(ret) AS n FROM e, range(-2, 4) t(o), r WHERE r.code = e.code AND r.k = e.k + o GROUP BY factor_quantile, o""",
    ("mean", "std"),
)
def event_window_returns(spark, sf_dir):
    return evaluation.event_window(quantile_data(spark, sf_dir), monthly(spark, sf_dir), "ret", 2, 3)


@query(
    f"""WITH i AS (SELECT ic_fwd_1 AS ic, row_number() OVER (ORDER BY date_) AS i, count(*) OVER () AS n FROM ({IC_SQL}) WHERE ic_fwd_1 IS NOT NULL)
        SELECT avg(CASE WHEN i <= n // 2 THEN ic END) AS first, avg(CASE WHEN i > n // 2 THEN ic END) AS second FROM i""",
    ("first", "second"),
)
def ic_split(spark, sf_dir):
    return inference.split_means(ic_spearman(spark, sf_dir), "ic_fwd_1")


@query(
    f"""WITH q AS ({QUANTILE_SQL}), l AS (SELECT date_, code, factor, factor_quantile, 1 AS horizon, fwd_1 AS fwd FROM q UNION ALL SELECT date_, code, factor, factor_quantile, 3, fwd_3 FROM q),
        s AS (SELECT horizon, date_, avg(CASE WHEN factor_quantile = 5 THEN fwd END) - avg(CASE WHEN factor_quantile = 1 THEN fwd END) AS spread FROM l GROUP BY horizon, date_)
        SELECT CAST(horizon AS INTEGER) AS horizon, avg(spread) AS spread, stddev_samp(spread) AS std, count(spread) AS n FROM s GROUP BY horizon""",
    ("spread", "std"),
)
def horizon_spreads(spark, sf_dir):
    data = factor_data(spark, sf_dir)
    return evaluation.holding_periods(data, monthly(spark, sf_dir), "factor", [1, 3]).drop("ic")
