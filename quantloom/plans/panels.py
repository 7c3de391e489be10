"""Panels of ``(date_, code, ...)`` over the driver's tables: as Spark plans, and as SQL.

A market panel comes from orders: an order's price is a trade, a priority a code; the
first and last order of a day give its open and close.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_columns(df: DataFrame) -> DataFrame:
    """Derived columns of a bar panel: vwap, return and value; the return counts rows of a code."""
    from pyspark.sql import Window

    w = Window.partitionBy("code").orderBy("date_")
    vwap = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    ret = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1
    return df.select("*", vwap.alias("vwap"), ret.alias("ret"), (F.col("close") * F.col("volume")).alias("cap"))


def _bars(df: DataFrame) -> DataFrame:
    price, key = F.col("o_totalprice").cast("double"), F.col("o_orderkey")
    return df.groupBy("code", "date_").agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        (F.sum(key % 1000) + F.count("*")).cast("double").alias("volume"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: bars per order priority and day."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("code"), F.to_date("o_orderdate").alias("date_"), "o_totalprice", "o_orderkey")
    bars = _bars(orders).withColumns(
        {
            "industry": F.when(F.col("code") < "3", "fast").otherwise("slow"),
            "sector": F.when(F.col("code") < "4", "first").otherwise("rest"),
            "subindustry": F.when(F.col("code") < "2", "urgent").when(F.col("code") < "4", "usual").otherwise("late"),
        }
    )
    return market_columns(bars)


#: Column of each class of codes in :func:`daily`.
CLASSES = (("sector", "sector"), ("industry", "industry"), ("subindustry", "subindustry"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 with the mean open and close of each day as a benchmark."""
    from pyspark.sql import Window

    day = Window.partitionBy("date_")
    return daily(spark, sf_dir).select("*", F.avg("open").over(day).alias("index_open"), F.avg("close").over(day).alias("index_close"))


DAILY_SQL = """
    SELECT *, (open + high + low + close) / 4 AS vwap, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date_), 0) - 1 AS ret, close * volume AS cap
    FROM (SELECT o_orderpriority AS code, CAST(o_orderdate AS DATE) AS date_,
                 min_by(CAST(o_totalprice AS DOUBLE), o_orderkey) AS open, max(CAST(o_totalprice AS DOUBLE)) AS high, min(CAST(o_totalprice AS DOUBLE)) AS low,
                 max_by(CAST(o_totalprice AS DOUBLE), o_orderkey) AS close, CAST(sum(o_orderkey % 1000) + count(*) AS DOUBLE) AS volume,
                 CASE WHEN o_orderpriority < '3' THEN 'fast' ELSE 'slow' END AS industry, CASE WHEN o_orderpriority < '4' THEN 'first' ELSE 'rest' END AS sector,
                 CASE WHEN o_orderpriority < '2' THEN 'urgent' WHEN o_orderpriority < '4' THEN 'usual' ELSE 'late' END AS subindustry
          FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE))
"""
#: Columns of a vendor's flow panel, made of bars: name and its expression in both engines.
FLOWS = {
    "turn_rate": "volume / 1000", "turnover": "close * volume", "change_pct": "ret", "rocttm": "(close - open) / (high + low) + 1.5", "net_flow": "volume * (1 + (close - low) / (high + low))", "vroc12": "(volume - 500) / 100",
    "reinstatement": "(close - low) / 1000", "main_flow": "volume * (close - open) / (close + open)", "main_flow20": "volume * (high + 1) / (low + 1)", "large_flow": "volume * close / (high + 1)", "vol60": "(high + low) / 1000", "tvsd20": "(open + close) / 500", "beta": "close / (open + 1)", "size": "ln(cap)",
}


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).selectExpr("*", *(f"{e} AS {n}" for n, e in FLOWS.items()))


FLOWS_SQL = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in FLOWS.items())} FROM ({DAILY_SQL})"
#: Columns of a panel of accounts, made of monthly bars: name and its expression in both engines. Some have gaps.
ACCOUNTS = {
    "market": "cap", "assets": "(open + high + low + close) * 10", "liabilities": "(high + low) * 8", "equity": "(close + open) * 6 - high * 2", "all_equity": "(close + open) * 6", "current_assets": "(open + close) * 7",
    "current_debts": "(low + close) * 3", "cash": "low * 2 + volume", "short_debt": "open * 0.7", "long_debt": "(open + high) * 2", "inventory": "close * 1.5 + volume", "receivables": "high * 1.3", "plant": "(high + close) * 4", "plant_net": "(high + close) * 3 - low",
    "sales": "(open + volume) * 9", "costs": "(low + volume) * 5", "overhead": "close + volume * 2", "interest": "open * 0.2", "income": "close * 2 - open", "net_income": "close * 2 - open * 1.1", "operating_income": "close * 3 - low", "depreciation": "high * 0.4", "tax": "close * 0.3",
    "tax_payable": "CASE WHEN close > open THEN close * 0.1 END", "deferred_tax": "CASE WHEN close > open THEN low * 0.2 END", "preferred": "CASE WHEN high > open * 2 THEN open * 0.1 ELSE 0 END", "capex": "(high - low) + open", "research": "CASE WHEN close > low THEN volume * 11 + close END",
    "advertising": "CASE WHEN high > close THEN volume * 3 + 1 END", "employees": "volume + open / 1000", "dividends": "low * 0.3", "buybacks": "(high - close) * 0.5", "issues": "(close - low) * 0.4", "debt_issues": "CASE WHEN close > open THEN open * 0.9 ELSE 0 END", "debt_paid": "low * 0.6",
    "operating_cash": "CASE WHEN volume > 1500 THEN close * 2 - low END", "long_investments": "open * 0.8 + volume", "short_investments": "CASE WHEN low < open THEN low * 0.5 END", "minority": "CASE WHEN close > open THEN volume END", "intangibles": "volume * 4", "deferred_revenue": "open * 0.15 + volume", "backlog": "CASE WHEN open > close THEN high ELSE 0 END",
    "payables": "low * 1.2 + volume", "securities": "CASE WHEN close > open THEN low * 0.1 ELSE 0 END", "price": "close / 1000", "shares": "volume + 1000", "traded": "volume * 3", "short_interest": "volume * 0.1 + 5", "estimate": "(open + close) / 2000", "estimate_spread": "(high - low) / 3000", "actual": "(high + low) / 2100",
    "growth_forecast": "(close - low) / 500 + 1", "dividend": "CASE WHEN close > open * 1.5 THEN low / 50000 ELSE 0 END", "high_price": "high / 1000", "income_q": "close - open * 0.6", "assets_q": "(open + close) * 20", "equity_q": "(close + low) * 6", "sales_q": "(open + volume) * 2", "cash_q": "low + volume", "tax_q": "close * 0.08",
}


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).selectExpr("date_", "code", "industry", "ret", *(f"CAST({e} AS DOUBLE) AS {n}" for n, e in ACCOUNTS.items()))


INDEXED_SQL = f"SELECT *, avg(open) OVER (PARTITION BY date_) AS index_open, avg(close) OVER (PARTITION BY date_) AS index_close FROM ({DAILY_SQL})"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2: bars per nation of the customer and month; the group is the nation's region."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("code"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("code"), F.col("n_regionkey").cast("int").alias("industry"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.trunc(F.to_date("o_orderdate"), "month").alias("date_"), "o_totalprice", "o_orderkey")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return market_columns(_bars(joined).join(F.broadcast(nations), "code"))  # nations: 25 rows by definition


MONTHLY_SQL = """
    SELECT *, (open + high + low + close) / 4 AS vwap, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date_), 0) - 1 AS ret, close * volume AS cap
    FROM (SELECT CAST(c_nationkey AS INTEGER) AS code, CAST(date_trunc('month', o_orderdate) AS DATE) AS date_,
                 min_by(CAST(o_totalprice AS DOUBLE), o_orderkey) AS open, max(CAST(o_totalprice AS DOUBLE)) AS high, min(CAST(o_totalprice AS DOUBLE)) AS low,
                 max_by(CAST(o_totalprice AS DOUBLE), o_orderkey) AS close, CAST(sum(o_orderkey % 1000) + count(*) AS DOUBLE) AS volume,
                 CAST(any_value(n_regionkey) AS INTEGER) AS industry
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
          GROUP BY CAST(c_nationkey AS INTEGER), CAST(date_trunc('month', o_orderdate) AS DATE))
"""
ACCOUNTS_SQL = f"SELECT date_, code, industry, ret, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in ACCOUNTS.items())} FROM ({MONTHLY_SQL})"
