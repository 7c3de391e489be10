"""Queries of books: exposures, weights, limits, trades, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import books, portfolio
from quantloom.plans.panels import MONTHLY_SQL, daily, monthly
from quantloom.plans.research import TOP_SQL, TRADES_SQL, _corr, factor_data, query
from quantloom.plans.scoring import NAMES, STACK_SQL, WIDE_SQL, many, placed_sql, wide


def tops(spark, sf_dir):
    """The five best codes of a date against the five worst."""
    return portfolio.top_weights(factor_data(spark, sf_dir), "factor", 5, short=True)


def held(spark, sf_dir):
    """Long-short weights with the codes' groups and sizes."""
    return tops(spark, sf_dir).join(monthly(spark, sf_dir).select("date_", "code", "industry", "cap", "close", "volume"), ["date_", "code"])


HELD_SQL = f"SELECT t.date_, t.code, t.weight, m.industry, m.cap, m.close, m.volume FROM ({TOP_SQL}) t JOIN ({MONTHLY_SQL}) m ON t.date_ = m.date_ AND t.code = m.code"
EXPOSURE_SQL = f"SELECT date_, industry, net / nullif(sum(gross) OVER (PARTITION BY date_), 0) AS exposure FROM (SELECT date_, industry, sum(weight) AS net, sum(abs(weight)) AS gross FROM ({HELD_SQL}) GROUP BY date_, industry)"


@query(EXPOSURE_SQL, ("exposure",))
def book_industry_exposure(spark, sf_dir):
    return books.industry_exposure(held(spark, sf_dir))


@query(
    f"""SELECT date_, max(x) AS largest, min(x) AS least, stddev_pop(x) AS concentration, sum(CASE WHEN k <= 3 THEN x END) AS top3
        FROM (SELECT date_, abs(exposure) AS x, row_number() OVER (PARTITION BY date_ ORDER BY abs(exposure) DESC) AS k FROM ({EXPOSURE_SQL})) GROUP BY date_""",
    ("largest", "least", "concentration", "top3"),
)
def book_exposure_summary(spark, sf_dir):
    return books.exposure_summary(books.industry_exposure(held(spark, sf_dir)))


@query(f"SELECT date_, code, cap / sum(cap) OVER (PARTITION BY date_) AS weight FROM ({MONTHLY_SQL})", ("weight",))
def book_cap_weights(spark, sf_dir):
    return books.cap_weights(monthly(spark, sf_dir))


@query(
    f"""WITH p AS (SELECT *, sum(abs(weight)) OVER (PARTITION BY date_) AS gross FROM ({TOP_SQL}))
        SELECT p.date_, sum(weight * momentum / gross) AS momentum, sum(weight * size / gross) AS size FROM p JOIN ({WIDE_SQL}) f ON p.date_ = f.date_ AND p.code = f.code GROUP BY p.date_""",
    ("momentum", "size"),
)
def book_factor_exposures(spark, sf_dir):
    return books.factor_exposures(tops(spark, sf_dir), wide(spark, sf_dir), ["momentum", "size"])


@query(
    f"""WITH x AS (SELECT date_, code, abs(weight) / sum(abs(weight)) OVER (PARTITION BY date_) AS x FROM (SELECT date_, code, cap AS weight FROM ({MONTHLY_SQL}))),
        r AS (SELECT *, row_number() OVER (PARTITION BY date_ ORDER BY x DESC, code DESC) AS down, count(*) OVER (PARTITION BY date_) AS n FROM x)
        SELECT date_, sum(CASE WHEN down <= 10 THEN x END) AS top, sum(x * x) AS herfindahl, (max(n) + 1 - 2 * sum(x * down)) / max(n) AS gini FROM r GROUP BY date_""",
    ("top", "herfindahl", "gini"),
)
def book_concentration(spark, sf_dir):
    return books.concentration(monthly(spark, sf_dir).select("date_", "code", F.col("cap").alias("weight")))


@query(f"SELECT date_, sum(abs(trade)) / 2 AS turnover, sum(abs(trade)) AS gross_change FROM ({TRADES_SQL}) GROUP BY date_", ("turnover", "gross_change"))
def book_turnover(spark, sf_dir):
    return books.half_turnover(portfolio.trades(tops(spark, sf_dir)))


MIX = {"momentum": 0.5, "reversal": 0.3, "size": 0.2}


def _z(n: str, over: str) -> str:
    return f"CASE WHEN stddev_pop({n}) OVER ({over}) > 1e-9 THEN ({n} - avg({n}) OVER ({over})) / (stddev_pop({n}) OVER ({over})) END"


BLEND_SQL = f"SELECT date_, code, {' + '.join(f'coalesce(({_z(n, 'PARTITION BY date_')}) * {w}, 0)' for n, w in MIX.items())} AS score FROM ({WIDE_SQL})"


@query(BLEND_SQL, ("score",))
def book_blended(spark, sf_dir):
    return books.blended(wide(spark, sf_dir), MIX)


@query(f"SELECT date_, code, {' + '.join(f'coalesce(({_z(n, '')}) * {w}, 0)' for n, w in MIX.items())} AS score FROM ({WIDE_SQL})", ("score",))
def book_combined_score(spark, sf_dir):
    return books.whole_sample_score(wide(spark, sf_dir), MIX)


SCORED_SQL = f"SELECT date_, code, (score - avg(score) OVER d) / (stddev_pop(score) OVER d) AS z FROM ({BLEND_SQL}) WINDOW d AS (PARTITION BY date_)"
WEIGHTED_SQL = f"SELECT date_, code, z / nullif(sum(abs(z)) OVER (PARTITION BY date_), 0) AS weight FROM ({SCORED_SQL})"


def weighted(spark, sf_dir):
    return books.score_weights(books.blended(wide(spark, sf_dir), MIX))


@query(WEIGHTED_SQL, ("weight",))
def book_score_weights(spark, sf_dir):
    return weighted(spark, sf_dir)


@query(f"SELECT date_, code, greatest(z, 0) / nullif(sum(greatest(z, 0)) OVER (PARTITION BY date_), 0) AS weight FROM ({SCORED_SQL})", ("weight",))
def book_long_weights(spark, sf_dir):
    return books.score_weights(books.blended(wide(spark, sf_dir), MIX), long_only=True)


@query(f"SELECT date_, code, exp(score) / sum(exp(score)) OVER (PARTITION BY date_) AS weight FROM ({BLEND_SQL})", ("weight",))
def book_softmax_weights(spark, sf_dir):
    return books.softmax_weights(books.blended(wide(spark, sf_dir), MIX))


@query(
    f"""SELECT date_, code, weight, side, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY date_, side ORDER BY round(abs(weight), 9) DESC, code) AS INTEGER) AS place
        FROM (SELECT *, CAST(sign(weight) AS INTEGER) AS side FROM ({WEIGHTED_SQL}) WHERE weight <> 0)) WHERE place <= 3""",
    ("weight",),
)
def book_top_holdings(spark, sf_dir):
    rounded = weighted(spark, sf_dir).withColumn("weight", F.round("weight", 9))
    return books.top_holdings(rounded, 3)


NAMED_SQL = f"SELECT name, date_, avg(CASE WHEN factor_quantile = 5 THEN fwd_1 END) - avg(CASE WHEN factor_quantile = 1 THEN fwd_1 END) AS ret FROM ({placed_sql(STACK_SQL, 'name, date_')}) GROUP BY name, date_"


def named_returns(spark, sf_dir):
    from quantloom.operators.scorecard import legs, placed

    return legs(placed(many(spark, sf_dir)), "fwd_1", 5, ("name", "date_")).select("name", "date_", F.col("spread").alias("ret"))


METHODS_SQL = f"""
    WITH s AS (SELECT name, avg(coalesce(ret, 0)) AS m, stddev_pop(coalesce(ret, 0)) AS s FROM ({NAMED_SQL}) GROUP BY name),
    r AS (SELECT name, 'equal_weight' AS method, 1.0 AS raw FROM s UNION ALL SELECT name, 'ic_weight', greatest(m / s, 0) FROM s UNION ALL SELECT name, 'risk_parity', 1 / s FROM s
          UNION ALL SELECT name, 'max_sharpe', greatest(m / s * sqrt(252), 0) FROM s UNION ALL SELECT name, 'min_variance', 1 / (s * s + 1e-8) FROM s)
    SELECT name, method, CASE WHEN sum(raw) OVER (PARTITION BY method) > 0 THEN raw / sum(raw) OVER (PARTITION BY method) ELSE 1.0 / count(*) OVER (PARTITION BY method) END AS weight FROM r
"""


@query(METHODS_SQL, ("weight",))
def weights_by_method(spark, sf_dir):
    return books.weight_methods(named_returns(spark, sf_dir))


STRATEGY_SQL = f"SELECT w.method, r.date_, sum(w.weight * coalesce(r.ret, 0)) AS ret FROM ({NAMED_SQL}) r JOIN ({METHODS_SQL}) w ON w.name = r.name GROUP BY w.method, r.date_"


def strategy_returns(spark, sf_dir):
    returns = named_returns(spark, sf_dir)
    return books.weighted_returns(returns, books.weight_methods(returns))


COMPARED_SQL = f"""
    WITH w AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY method ORDER BY date_ ROWS UNBOUNDED PRECEDING)) AS w FROM ({STRATEGY_SQL}) WHERE ret > -1),
    d AS (SELECT *, w / greatest(max(w) OVER (PARTITION BY method ORDER BY date_ ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS dd FROM w),
    a AS (SELECT method, exp(avg(ln(1 + ret)) * 252) - 1 AS growth, stddev_pop(ret) * sqrt(252) AS volatility, avg(ret) / stddev_pop(ret) * sqrt(252) AS sharpe, min(dd) AS drawdown, avg(CAST(ret > 0 AS DOUBLE)) AS win_rate FROM d GROUP BY method)
    SELECT *, CAST(row_number() OVER (ORDER BY sharpe DESC NULLS LAST, method) AS INTEGER) AS place FROM a
"""


@query(COMPARED_SQL, ("growth", "volatility", "sharpe", "drawdown", "win_rate"))
def strategies_compared(spark, sf_dir):
    return books.strategies(strategy_returns(spark, sf_dir))


@query(
    f"""SELECT method, (coalesce(least(greatest(sharpe / 2.0, 0), 1), 0) * 0.6 + coalesce(least(greatest(win_rate / 1.0, 0), 1), 0) * 0.4) * 100 AS score FROM ({COMPARED_SQL})""",
    ("score",),
)
def strategies_scored(spark, sf_dir):
    return books.scored(books.strategies(strategy_returns(spark, sf_dir)), {"sharpe": (0.6, 2.0), "win_rate": (0.4, 1.0)}).select("method", "score")


@query(
    f"""WITH p AS (SELECT date_, {', '.join(f"max(CASE WHEN name = '{n}' THEN ret END) AS {n}" for n in NAMES)} FROM ({NAMED_SQL}) GROUP BY date_)
        {' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {_corr(a, b)} AS corr FROM p" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :])}""",
    ("corr",),
)
def return_correlations(spark, sf_dir):
    return books.return_correlations(named_returns(spark, sf_dir), "name", NAMES)


RULES = books.Tradeable(min_price=100000.0, min_volume=2000.0, min_value=1e8, window=6, min_codes=5)
TRADEABLE_SQL = f"""
    WITH t AS (SELECT date_, code, coalesce(close > 0 AND volume > 0 AND close >= 100000 AND avg(volume) OVER w >= 2000 AND avg(close * volume) OVER w >= 1e8, FALSE) AS ok FROM ({MONTHLY_SQL}) WINDOW w AS (PARTITION BY code ORDER BY date_ ROWS 5 PRECEDING))
    SELECT date_, code, ok AND sum(CAST(ok AS INTEGER)) OVER (PARTITION BY date_) >= 5 AS eligible FROM t
"""


@query(TRADEABLE_SQL)
def tradeable_universe(spark, sf_dir):
    return books.tradeable(monthly(spark, sf_dir), RULES).select("date_", "code", "eligible")


@query(f"SELECT date_, sum(CAST(eligible AS INTEGER)) AS eligible, count(*) AS universe, sum(CAST(eligible AS INTEGER)) / CAST(count(*) AS DOUBLE) AS share FROM ({TRADEABLE_SQL}) GROUP BY date_", ("eligible", "share"))
def tradeable_counts(spark, sf_dir):
    return books.eligible_counts(books.tradeable(monthly(spark, sf_dir), RULES))


@query(f"SELECT b.date_, b.code, CASE WHEN t.eligible THEN b.score END AS score FROM ({BLEND_SQL}) b LEFT JOIN ({TRADEABLE_SQL}) t ON b.date_ = t.date_ AND b.code = t.code", ("score",))
def tradeable_scores(spark, sf_dir):
    return books.masked_scores(books.blended(wide(spark, sf_dir), MIX), books.tradeable(monthly(spark, sf_dir), RULES))


@query()
def book_limited(spark, sf_dir):
    """Caps by name and group are found round by round, which SQL can't state; tested against the limits."""
    long = books.score_weights(books.blended(wide(spark, sf_dir), MIX), long_only=True)
    return books.limited(long.join(monthly(spark, sf_dir).select("date_", "code", "industry"), ["date_", "code"]), 0.15, 0.4)


TRANSACTIONS_SQL = f"""
    WITH s AS (SELECT m.date_, m.code, m.close, coalesce(t.weight * 1e6 / nullif(m.close, 0), 0) AS shares FROM ({MONTHLY_SQL}) m LEFT JOIN ({TOP_SQL}) t ON m.date_ = t.date_ AND m.code = t.code),
    a AS (SELECT *, shares - coalesce(lag(shares) OVER (PARTITION BY code ORDER BY date_), 0) AS amount FROM s)
    SELECT date_, code, amount, close AS price, -amount * close AS dollars FROM a WHERE abs(amount) > 1e-12
"""


def traded(spark, sf_dir):
    return books.transactions(tops(spark, sf_dir), monthly(spark, sf_dir))


@query(TRANSACTIONS_SQL, ("amount", "price", "dollars"))
def book_transactions(spark, sf_dir):
    return traded(spark, sf_dir)


def fills(spark, sf_dir):
    """Whole shares bought or sold per code and day: the size and side of the day's move."""
    rows = daily(spark, sf_dir).where("ret is not null")
    return rows.select("date_", "code", (F.signum("ret") * (1 + F.pmod(F.crc32(F.col("date_").cast("string").cast("binary")), F.lit(9)))).alias("amount"), F.col("close").alias("price"))


@query()
def book_round_trips(spark, sf_dir):
    """Matches first in, first out; tested against a loop over lots."""
    return books.round_trips(fills(spark, sf_dir))


@query(f"SELECT date_, code, (cap - avg(cap) OVER (PARTITION BY industry)) / nullif(stddev_pop(cap) OVER (PARTITION BY industry), 0) AS neutral FROM ({MONTHLY_SQL})", ("neutral",))
def book_neutral_industry(spark, sf_dir):
    w = Window.partitionBy("industry")
    return monthly(spark, sf_dir).select("date_", "code", F.try_divide(F.col("cap") - F.avg("cap").over(w), F.stddev_pop("cap").over(w)).alias("neutral"))


@query(
    f"""WITH p AS (SELECT date_, code, momentum, size FROM ({WIDE_SQL}) WHERE momentum IS NOT NULL AND size IS NOT NULL), l AS (SELECT regr_slope(momentum, size) AS b, avg(momentum) AS my, avg(size) AS mx FROM p)
        SELECT date_, code, momentum - my - b * (size - mx) AS neutral FROM p, l""",
    ("neutral",),
)
def book_neutral_cap(spark, sf_dir):
    rows = wide(spark, sf_dir).where("momentum is not null and size is not null")
    line = rows.agg(F.regr_slope("momentum", "size").alias("b"), F.avg("momentum").alias("my"), F.avg("size").alias("mx"))
    return rows.join(F.broadcast(line)).select("date_", "code", (F.col("momentum") - F.col("my") - F.col("b") * (F.col("size") - F.col("mx"))).alias("neutral"))  # one row
