"""Portfolios from factors: weights, backtests with costs, trades, return analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_weights(data: DataFrame, factor: str, n: int, *, short: bool = False) -> DataFrame:
    """Equal weights of the n best codes per date; with ``short``, the n worst at minus that."""
    w = Window.partitionBy("date_")
    r = F.round(factor, 9)
    best = F.row_number().over(w.orderBy(r.desc_nulls_last(), "code"))
    worst = F.row_number().over(w.orderBy(r.asc_nulls_last(), "code"))
    ranked = data.where(F.col(factor).isNotNull()).select("*", best.alias("__b"), worst.alias("__w"))
    side = F.when(F.col("__b") <= n, F.lit(1.0))
    if short:
        side = side.when(F.col("__w") <= n, F.lit(-1.0))
    held = ranked.withColumn("side", side).where("side is not null")
    count = F.count("*").over(Window.partitionBy("date_", "side"))
    return held.select("date_", "code", (F.col("side") / count).alias("weight"))


def capped(weights: DataFrame, cap: float, rounds: int = 4) -> DataFrame:
    """Weights of a date cut at ``cap``; in each round, what is cut off goes to the others in proportion."""
    w = Window.partitionBy("date_")
    out = weights
    for _ in range(rounds):
        over = F.col("weight") >= cap
        room = F.sum(F.when(~over, F.col("weight"))).over(w)
        excess = F.sum(F.when(over, F.col("weight") - cap).otherwise(0.0)).over(w)
        out = out.withColumn("weight", F.when(over, F.lit(cap)).otherwise(F.col("weight") * (1 + F.coalesce(F.try_divide(excess, room), F.lit(0.0)))))
    return out


def trades(weights: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Changes of weight between one rebalance and the next, codes that leave included."""
    from quantloom.operators.align import sessions

    calendar = sessions(dates if dates is not None else weights)
    turned = _turned(weights.withColumn("__r", F.lit(0.0)), calendar)
    return turned.join(F.broadcast(calendar), "k").select("date_", "code", "trade")  # a row per rebalance


def _turned(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """(k, code, trade, gross): what is held at a rebalance less what was held at the one before, in one aggregation.

    Every weight counts at its own rebalance, and is taken off at the next.
    """
    own = F.struct(F.col("k").alias("k"), F.col("weight").alias("w"), (F.col("weight") * F.coalesce("__r", F.lit(0.0))).alias("g"))
    after = F.struct((F.col("k") + 1).alias("k"), (-F.col("weight")).alias("w"), F.lit(0.0).alias("g"))
    both = rows.join(F.broadcast(calendar), "date_").select("code", F.explode(F.array(own, after)).alias("x"))
    return both.groupBy("x.k", "code").agg(F.sum("x.w").alias("trade"), F.sum("x.g").alias("gross"))


def backtest(weights: DataFrame, returns: DataFrame, column: str, cost: float = 0.0) -> DataFrame:
    """Per rebalance: gross return of the held codes over the next period, turnover, net return, equity."""
    from quantloom.operators.align import sessions

    calendar = sessions(weights)
    rows = weights.join(returns.select("date_", "code", F.col(column).alias("__r")), ["date_", "code"], "left")
    net = _turned(rows, calendar).groupBy("k").agg(F.sum("gross").alias("gross"), F.sum(F.abs("trade")).alias("turnover"))
    net = net.join(F.broadcast(calendar), "k").withColumn("net", F.col("gross") - cost * F.col("turnover")).drop("k")
    curve = F.exp(F.sum(F.log1p(F.when(F.col("net") > -1, F.col("net")))).over(Window.orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)))  # one row per rebalance date
    return net.withColumn("equity", F.when(F.col("net") > -1, curve))


def performance(returns: DataFrame, column: str, by: list[str], periods: int = 252) -> DataFrame:
    """Return analytics per group: growth, risk, ratios, tails."""
    x = F.col(column)
    n, mean, std = F.count(x), F.avg(x), F.stddev_samp(x)
    total = F.exp(F.sum(F.log1p(x))) - 1
    root = float(periods) ** 0.5
    down_all = F.sqrt(F.sum(F.when(x < 0, x * x).otherwise(F.when(x.isNotNull(), 0.0))) / n)
    down_some = F.sqrt(F.avg(F.when(x < 0, x * x)))
    tail = F.percentile(x, 0.05)
    return returns.where(x > -1).groupBy(*by).agg(
        n.alias("n"),
        total.alias("total"),
        (F.pow(1 + total, F.lit(float(periods)) / n) - 1).alias("cagr"),
        (std * root).alias("volatility"),
        (F.try_divide(mean, std) * root).alias("sharpe"),
        (F.try_divide(mean, down_all) * root).alias("sortino"),
        (F.try_divide(mean, down_some) * root).alias("sortino_losses"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.try_divide(F.avg(F.when(x > 0, x)), -F.avg(F.when(x < 0, x))).alias("payoff"),
        F.try_divide(F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x))).alias("profit_factor"),
        F.max(x).alias("best"),
        F.min(x).alias("worst"),
        tail.alias("var_95"),
    )


def drawdowns(returns: DataFrame, column: str, by: str = "code") -> DataFrame:
    """Wealth and distance from its peak after each row."""
    w = Window.partitionBy(by).orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)
    wealth = returns.where(F.col(column) > -1).withColumn("wealth", F.exp(F.sum(F.log1p(column)).over(w)))
    return wealth.withColumn("drawdown", F.col("wealth") / F.greatest(F.max("wealth").over(w), F.lit(1.0)) - 1)


def resample_month(returns: DataFrame, column: str) -> DataFrame:
    """Compounded return, last value and sum per code and month."""
    return returns.groupBy("code", F.trunc("date_", "month").alias("month")).agg(
        (F.exp(F.sum(F.log1p(F.when(F.col(column) > -1, F.col(column))))) - 1).alias("compounded"), F.max_by(column, "date_").alias("last"), F.sum(column).alias("total")
    )
