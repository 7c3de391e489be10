"""Queries of monthly panels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import monthly as months
from quantloom.plans.panels import MONTHLY_SQL, monthly, table
from quantloom.plans.research import query

#: The panel with every fifth row missing, so that months are gaps.
GAPS_SQL = f"SELECT *, year(date_) * 12 + month(date_) AS m FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date_) AS k FROM ({MONTHLY_SQL})) WHERE k % 5 <> 0"


def gaps(spark, sf_dir):
    from pyspark.sql import Window

    return monthly(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("date_"))).where("k % 5 <> 0")


def _range(first: int, last: int) -> str:
    side = lambda n: "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    return f"(PARTITION BY code ORDER BY m RANGE BETWEEN {side(first)} AND {side(last)})"


@query(
    f"""SELECT date_, code, CASE WHEN count(close) OVER w >= 3 THEN avg(close) OVER w END AS mean, CASE WHEN count(close) OVER w >= 3 THEN stddev_samp(close) OVER w END AS std, CASE WHEN count(close) OVER w >= 3 THEN quantile_cont(close, 0.5) OVER w END AS median,
               CASE WHEN count(close) OVER w >= 3 THEN max(close) OVER w END AS high, count(close) OVER w AS n FROM ({GAPS_SQL}) WINDOW w AS {_range(-5, 0)}""",
    ("mean", "std", "median", "high"),
)
def months_rolling(spark, sf_dir):
    p = gaps(spark, sf_dir)
    stats = {"mean": "mean", "std": "std", "median": "median", "high": "max"}
    return p.select("date_", "code", *(months.over_months(p, "close", 6, s, 3).alias(n) for n, s in stats.items()), months.over_months(p, "close", 6, "count").alias("n"))


@query(f"SELECT date_, code, max(close) OVER {_range(-1, -1)} AS l1_close, max(close) OVER {_range(-12, -12)} AS l12_close FROM ({GAPS_SQL})", ("l1_close", "l12_close"))
def months_lagged(spark, sf_dir):
    return months.with_lags(gaps(spark, sf_dir).select("date_", "code", "close"), ["close"], [1, 12]).drop("close")


@query(
    f"""WITH s AS (SELECT code, min(date_) AS a, max(date_) AS b FROM ({GAPS_SQL}) GROUP BY code), e AS (SELECT code, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS date_ FROM s)
        SELECT e.date_, e.code, g.close FROM e LEFT JOIN ({GAPS_SQL}) g ON g.date_ = e.date_ AND g.code = e.code""",
    ("close",),
)
def months_filled(spark, sf_dir):
    return months.filled_months(gaps(spark, sf_dir).select("date_", "code", "close"))


@query(f"SELECT date_, code, last_value(CASE WHEN month(date_) % 3 = 0 THEN close END IGNORE NULLS) OVER {_range(-2, 0)} AS report FROM ({GAPS_SQL})", ("report",))
def months_quarterly(spark, sf_dir):
    p = gaps(spark, sf_dir).withColumn("q", F.when(F.month("date_") % 3 == 0, F.col("close")))
    return p.select("date_", "code", months.held_for("q", 2).alias("report"))


GROUP_SQL = f"SELECT *, CAST(1 + {' + '.join(f'CAST(close > quantile_cont(close, {i / 5!r}) OVER d * (1 + 1e-12) AS INTEGER)' for i in range(1, 5))} AS INTEGER) AS grp FROM ({GAPS_SQL}) WINDOW d AS (PARTITION BY date_)"


@query(f"SELECT date_, code, grp, cume_dist() OVER (PARTITION BY date_ ORDER BY close) AS place FROM ({GROUP_SQL})", ("place",))
def months_grouped(spark, sf_dir):
    return gaps(spark, sf_dir).select("date_", "code", months.quantile_group("close", 5).alias("grp"), months.relative_rank("close").alias("place"))


@query(
    f"""SELECT date_, code, least(greatest(close, quantile_cont(close, 0.1) OVER d), quantile_cont(close, 0.9) OVER d) AS winsorized, CASE WHEN close BETWEEN quantile_cont(close, 0.1) OVER d AND quantile_cont(close, 0.9) OVER d THEN close END AS trimmed
        FROM ({MONTHLY_SQL}) WINDOW d AS (PARTITION BY date_)""",
    ("winsorized", "trimmed"),
)
def months_clipped(spark, sf_dir):
    return monthly(spark, sf_dir).select("date_", "code", months.clipped("close", 0.1, 0.9).alias("winsorized"), months.clipped("close", 0.1, 0.9, trim=True).alias("trimmed"))


PORT_SQL = f"""
    WITH h AS (SELECT date_, ret, max(grp) OVER {_range(-1, -1)} AS port, max(cap) OVER {_range(-1, -1)} AS w FROM ({GROUP_SQL}))
    SELECT date_, port, sum(ret * w) / sum(w) AS ret, count(*) AS n FROM h WHERE port IS NOT NULL AND w IS NOT NULL AND ret IS NOT NULL GROUP BY date_, port
"""


@query(PORT_SQL, ("ret",))
def portfolios_sorted(spark, sf_dir):
    return months.sorted_portfolios(gaps(spark, sf_dir), "close", "ret", 5, weight="cap")


@query(f"SELECT date_, max(CASE WHEN port = 5 THEN ret END) - max(CASE WHEN port = 1 THEN ret END) AS ret FROM ({PORT_SQL}) GROUP BY date_", ("ret",))
def portfolios_long_short(spark, sf_dir):
    return months.long_short(months.sorted_portfolios(gaps(spark, sf_dir), "close", "ret", 5, weight="cap"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10000 BETWEEN 100 AND 999 THEN 'farms' WHEN c_custkey % 10000 BETWEEN 1000 AND 1099 THEN 'mines' END AS industry FROM customer")
def industry_by_ranges(spark, sf_dir):
    ranges = spark.createDataFrame([(100, 999, "farms"), (1000, 1099, "mines")], "low int, high int, industry string")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 10000).cast("int").alias("sic"))
    return months.industry_of(rows, ranges).drop("sic")
