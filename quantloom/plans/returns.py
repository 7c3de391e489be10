"""Queries of return analytics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import ratios
from quantloom.operators.inference import ERF, ERF_P
from quantloom.plans.panels import DAILY_SQL, daily
from quantloom.plans.research import WEALTH_SQL, query


def cdf_sql(z: str) -> str:
    """The operators' approximation of the normal distribution."""
    x, k = f"(abs({z}) / sqrt(2.0))", f"(1 / (1 + {ERF_P} * abs({z}) / sqrt(2.0)))"
    poly = "0.0"
    for a in reversed(ERF):
        poly = f"(({poly} + {a}) * {k})"
    half = f"({poly} * exp(-{x} * {x}) / 2)"
    return f"CASE WHEN {z} >= 0 THEN 1 - {half} ELSE {half} END"


def _probable(r: str) -> str:
    z = f"({r} * sqrt(n - 1) / sqrt(1 - skew * {r} + (kurt - 1) / 4 * {r} * {r}))"
    return f"CASE WHEN 1 - skew * {r} + (kurt - 1) / 4 * {r} * {r} > 0 AND n > 1 THEN {cdf_sql(z)} END"


LAGGED_SQL = f"SELECT code, ret AS y, lag(ret) OVER (PARTITION BY code ORDER BY date_) AS x FROM ({DAILY_SQL}) WHERE ret > -1"

RATIO_COLUMNS = (
    "comp", "avg_return", "expected_return", "implied_volatility", "cvar", "ulcer_index", "smart_sharpe", "smart_sortino", "risk_of_ruin", "rar", "ulcer_performance", "serenity_index",
    "profit_ratio", "probabilistic_sharpe", "probabilistic_sortino", "probabilistic_smart_sortino",
)


@query(
    f"""WITH w AS (SELECT *, avg(ret) OVER c - 1.6448536269514722 * stddev_samp(ret) OVER c AS v, avg(dd) OVER c - 1.6448536269514722 * stddev_samp(dd) OVER c AS dv FROM ({WEALTH_SQL}) WINDOW c AS (PARTITION BY code)),
        a AS (SELECT code, count(ret) AS n, exp(sum(ln(1 + ret))) - 1 AS comp, avg(CASE WHEN ret <> 0 THEN ret END) AS avg_return, exp(avg(ln(1 + ret))) - 1 AS expected_return, stddev_samp(ln(1 + ret)) AS implied_volatility,
                     avg(CAST(ret > 0 AS DOUBLE)) AS rate, avg(CAST(ret <> 0 AS DOUBLE)) AS exposed, coalesce(avg(CASE WHEN ret < v THEN ret END), any_value(v)) AS cvar, coalesce(avg(CASE WHEN dd < dv THEN dd END), any_value(dv)) AS dd_cvar,
                     sqrt(sum(dd * dd) / (count(ret) - 1)) AS ulcer_index, abs(avg(CASE WHEN ret >= 0 THEN ret END) / nullif(count(*) FILTER (WHERE ret >= 0), 0)) AS gain, abs(avg(CASE WHEN ret < 0 THEN ret END) / nullif(count(*) FILTER (WHERE ret < 0), 0)) AS loss,
                     avg(ret) / stddev_pop(ret) * sqrt(252) AS sharpe, avg(ret) / sqrt(sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) / count(ret)) * sqrt(252) AS sortino, sum(ret) AS total, stddev_samp(ret) AS std, skewness(ret) AS skew, kurtosis(ret) AS kurt
              FROM w GROUP BY code),
        p AS (SELECT code, abs(covar_samp(y, x) / (stddev_samp(x) * stddev_samp(y))) AS r, CAST(count(*) + 1 AS DOUBLE) AS m FROM ({LAGGED_SQL}) WHERE x IS NOT NULL GROUP BY code),
        q AS (SELECT code, sqrt(1 + 2 * (r / (1 - r) - r * (1 - pow(r, m)) / (m * pow(1 - r, 2)))) AS penalty FROM p),
        s AS (SELECT a.*, sharpe / penalty AS smart_sharpe, sortino / penalty AS smart_sortino FROM a LEFT JOIN q ON a.code = q.code)
        SELECT code, comp, avg_return, expected_return, implied_volatility, cvar, ulcer_index, smart_sharpe, smart_sortino, pow((1 - rate) / (1 + rate), n) AS risk_of_ruin, (pow(1 + comp, 252.0 / n) - 1) / exposed AS rar,
               comp / ulcer_index AS ulcer_performance, total / (ulcer_index * (-dd_cvar / std)) AS serenity_index, gain / loss AS profit_ratio,
               {_probable('sharpe')} AS probabilistic_sharpe, {_probable('sortino')} AS probabilistic_sortino, {_probable('smart_sortino')} AS probabilistic_smart_sortino FROM s""",
    RATIO_COLUMNS,
)
def return_ratios(spark, sf_dir):
    return ratios.ratios(daily(spark, sf_dir), "ret")


@query(f"SELECT code, date_, exp(sum(ln(1 + ret)) OVER (PARTITION BY code ORDER BY date_ ROWS UNBOUNDED PRECEDING)) - 1 AS compounded FROM ({DAILY_SQL}) WHERE ret > -1", ("compounded",))
def return_compounded(spark, sf_dir):
    return ratios.compounded(daily(spark, sf_dir), "ret")


def _resampled(unit: str) -> str:
    return f"""SELECT code, CAST(date_trunc('{unit}', date_) AS DATE) AS start, exp(sum(ln(1 + r))) - 1 AS compounded, sum(r) AS total, max(r) AS best, min(r) AS worst, count(r) AS n
               FROM (SELECT *, CASE WHEN ret > -1 THEN ret END AS r FROM ({DAILY_SQL})) GROUP BY code, CAST(date_trunc('{unit}', date_) AS DATE)"""


@query(_resampled("year"), ("compounded", "total", "best", "worst"))
def return_yearly(spark, sf_dir):
    return ratios.resample(daily(spark, sf_dir), "ret", "year")


@query(_resampled("week"), ("compounded", "total", "best", "worst"))
def return_weekly(spark, sf_dir):
    return ratios.resample(daily(spark, sf_dir), "ret", "week")


def _outlying(sign: str) -> str:
    return f"SELECT code, date_, ret FROM (SELECT *, quantile_cont(ret, 0.95) OVER (PARTITION BY code) AS q FROM ({DAILY_SQL}) WHERE ret IS NOT NULL) WHERE ret {sign} q"


@query(_outlying(">"), ("ret",))
def return_outliers(spark, sf_dir):
    return ratios.outliers(daily(spark, sf_dir).select("code", "date_", "ret"), "ret")


@query(_outlying("<"), ("ret",))
def return_without_outliers(spark, sf_dir):
    return ratios.outliers(daily(spark, sf_dir).select("code", "date_", "ret"), "ret", inside=True)


@query(
    f"""WITH b AS (SELECT code, ret, min(ret) OVER (PARTITION BY code) AS lo, max(ret) OVER (PARTITION BY code) AS hi FROM ({DAILY_SQL}) WHERE ret IS NOT NULL)
        SELECT code, CASE WHEN hi > lo THEN CAST(least(floor(round((ret - lo) / (hi - lo) * 20, 9)), 19) AS INTEGER) ELSE 0 END AS bin, count(*) AS n FROM b GROUP BY ALL"""
)
def return_histogram(spark, sf_dir):
    return ratios.histogram(daily(spark, sf_dir), "ret")


MARKET_SQL = f"SELECT *, avg(ret) OVER (PARTITION BY date_) AS market FROM ({DAILY_SQL})"


def with_market(spark, sf_dir):
    return daily(spark, sf_dir).withColumn("market", F.avg("ret").over(Window.partitionBy("date_")))


@query(
    f"""WITH m AS (SELECT code, CAST(date_trunc('month', date_) AS DATE) AS start, exp(sum(ln(1 + CASE WHEN ret > -1 THEN ret END))) - 1 AS returns, exp(sum(ln(1 + CASE WHEN market > -1 THEN market END))) - 1 AS benchmark
                   FROM ({MARKET_SQL}) GROUP BY code, CAST(date_trunc('month', date_) AS DATE))
        SELECT *, returns / nullif(benchmark, 0) AS multiplier, CAST(returns >= benchmark AS INTEGER) AS won FROM m""",
    ("returns", "benchmark", "multiplier"),
)
def return_compared(spark, sf_dir):
    return ratios.compare(with_market(spark, sf_dir), "ret", "market")


@query(
    f"""WITH p AS (SELECT code, date_, CASE WHEN ret IS NOT NULL THEN market END AS x, CASE WHEN market IS NOT NULL THEN ret END AS y FROM ({MARKET_SQL})),
        b AS (SELECT *, CASE WHEN count(x) OVER w >= 60 AND var_samp(x) OVER w > 1e-12 THEN covar_samp(y, x) OVER w / var_samp(x) OVER w END AS beta FROM p WINDOW w AS (PARTITION BY code ORDER BY date_ ROWS 59 PRECEDING))
        SELECT code, date_, beta, (avg(y) OVER w - beta * avg(x) OVER w) * 252 AS alpha FROM b WINDOW w AS (PARTITION BY code ORDER BY date_ ROWS 59 PRECEDING)""",
    ("beta", "alpha"),
)
def return_rolling_greeks(spark, sf_dir):
    return ratios.rolling_greeks(with_market(spark, sf_dir), "ret", "market", 60)


@query()
def return_monte_carlo(spark, sf_dir):
    return ratios.monte_carlo(daily(spark, sf_dir), "ret", 200)
