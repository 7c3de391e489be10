"""Analysis of held books: exposures, concentration, caps on trading, weights of factors, trades and round trips.

Positions are long rows ``(date_, code, weight)``; every step groups by date (or by
strategy), so that many books are analysed in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.evaluation import corr_of


def industry_exposure(positions: DataFrame, group: str = "industry") -> DataFrame:
    """Net weight of each group over the gross weight of its date."""
    day = Window.partitionBy("date_")
    rows = positions.groupBy("date_", group).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("net"), F.sum(F.abs("weight")).alias("gross"))
    return rows.select("date_", group, F.coalesce(F.try_divide("net", F.sum("gross").over(day)), F.col("net")).alias("exposure"))


def exposure_summary(exposures: DataFrame) -> DataFrame:
    """Per date the largest and least absolute exposure, their deviation, and the sum of the three largest."""
    x = F.abs("exposure")
    ranked = exposures.select("date_", x.alias("x"), F.row_number().over(Window.partitionBy("date_").orderBy(x.desc())).alias("k"))
    return ranked.groupBy("date_").agg(F.max("x").alias("largest"), F.min("x").alias("least"), F.stddev_pop("x").alias("concentration"), F.sum(F.when(F.col("k") <= 3, F.col("x"))).alias("top3"))


def cap_weights(panel: DataFrame, cap: str = "cap") -> DataFrame:
    """Weights in proportion to a size; equal ones where a date has none."""
    day = Window.partitionBy("date_")
    total, n = F.sum(cap).over(day), F.count(cap).over(day)
    return panel.where(F.col(cap).isNotNull()).select("date_", "code", F.when(total > 0, F.col(cap) / total).otherwise(1 / n).alias("weight"))


def factor_exposures(positions: DataFrame, factors: DataFrame, names: Sequence[str]) -> DataFrame:
    """Weighted factor values per date, over the gross weight of all positions."""
    gross = F.sum(F.abs("weight")).over(Window.partitionBy("date_"))
    rows = positions.select("date_", "code", "weight", gross.alias("gross")).join(factors, ["date_", "code"])
    return rows.groupBy("date_").agg(*(F.sum(F.try_divide(F.col("weight") * F.col(n), F.col("gross"))).alias(n) for n in names))


def concentration(positions: DataFrame, k: int = 10) -> DataFrame:
    """Share of the k largest positions, sum of squared shares, and Gini coefficient per date."""
    day = Window.partitionBy("date_")
    x = F.abs("weight")
    rows = positions.where("weight is not null").select("date_", (x / F.sum(x).over(day)).alias("x"), F.row_number().over(day.orderBy(x, "code")).alias("up"), F.count("*").over(day).alias("n"))
    rows = rows.withColumn("down", F.col("n") - F.col("up") + 1)
    gini = (F.max("n") + 1 - 2 * F.sum(F.col("x") * F.col("down"))) / F.max("n")
    return rows.groupBy("date_").agg(F.sum(F.when(F.col("down") <= k, F.col("x"))).alias("top"), F.sum(F.col("x") * F.col("x")).alias("herfindahl"), gini.alias("gini"))


def half_turnover(trades: DataFrame) -> DataFrame:
    """Half of all changes of weight per date, and codes held before and after."""
    return trades.groupBy("date_").agg((F.sum(F.abs("trade")) / 2).alias("turnover"), F.sum(F.abs("trade")).alias("gross_change"))


def blended(panel: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of factors, each standardised per date; a missing one counts nothing."""
    day = Window.partitionBy("date_")

    def z(name: str) -> Column:
        sd = F.stddev_pop(name).over(day)
        return F.when(sd > 1e-9, (F.col(name) - F.avg(name).over(day)) / sd)

    scored = panel.select("date_", "code", *(z(n).alias(f"__z_{n}") for n in weights))
    return scored.select("date_", "code", sum((F.coalesce(F.col(f"__z_{n}") * w, F.lit(0.0)) for n, w in weights.items()), F.lit(0.0)).alias("score"))


def whole_sample_score(panel: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of factors standardised over all rows: two numbers per factor are joined back."""
    moments = panel.agg(*(x for n in weights for x in (F.avg(n).alias(f"__m_{n}"), F.stddev_pop(n).alias(f"__s_{n}"))))
    rows = panel.join(F.broadcast(moments))  # one row
    z = lambda n: F.when(F.col(f"__s_{n}") > 1e-9, (F.col(n) - F.col(f"__m_{n}")) / F.col(f"__s_{n}"))
    return rows.select("date_", "code", sum((F.coalesce(z(n) * w, F.lit(0.0)) for n, w in weights.items()), F.lit(0.0)).alias("score"))


def score_weights(scores: DataFrame, *, long_only: bool = False, gross: float = 1.0, column: str = "score") -> DataFrame:
    """Weights of a date from its standardised scores: what is above zero, or long and short around the mean, to a gross exposure."""
    day = Window.partitionBy("date_")
    sd = F.stddev_pop(column).over(day)
    z = scores.where(F.col(column).isNotNull()).select("date_", "code", F.when(sd > 1e-9, (F.col(column) - F.avg(column).over(day)) / sd).alias("__z"))
    z = z.withColumn("__w", F.greatest("__z", F.lit(0.0)) if long_only else F.col("__z"))
    return z.select("date_", "code", (F.try_divide("__w", F.sum(F.abs("__w")).over(day)) * gross).alias("weight"))


def softmax_weights(scores: DataFrame, temperature: float = 1.0, column: str = "score") -> DataFrame:
    day = Window.partitionBy("date_")
    e = F.exp((F.col(column) - F.max(column).over(day)) / temperature)
    rows = scores.where(F.col(column).isNotNull()).select("date_", "code", e.alias("__e"))
    return rows.select("date_", "code", (F.col("__e") / F.sum("__e").over(day)).alias("weight"))


def top_holdings(weights: DataFrame, n: int = 20) -> DataFrame:
    """The n largest long and short positions of a date."""
    day = Window.partitionBy("date_")
    rows = weights.where("weight <> 0").select("*", (F.signum("weight")).cast("int").alias("side"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("date_", "side").orderBy(F.abs("weight").desc(), "code"))).where(F.col("place") <= n)


def weight_methods(returns: DataFrame, *, periods: int = 252) -> DataFrame:
    """Weights of factors by five rules, from one aggregation of their returns ``(name, date_, ret)``.

    Equal; by ratio of mean to deviation, where positive; by inverse deviation; by positive Sharpe ratio;
    by inverse variance. Where no factor qualifies all get the same.
    """
    x = F.coalesce("ret", F.lit(0.0))
    stats = returns.groupBy("name").agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    ratio = F.coalesce(F.try_divide("m", "s"), F.lit(0.0))
    raw = {
        "equal_weight": F.lit(1.0),
        "ic_weight": F.greatest(ratio, F.lit(0.0)),
        "risk_parity": F.coalesce(F.try_divide(F.lit(1.0), F.col("s")), F.lit(0.0)),
        "max_sharpe": F.greatest(ratio * float(periods) ** 0.5, F.lit(0.0)),
        "min_variance": 1 / (F.col("s") * F.col("s") + 1e-8),
    }
    rows = stats.select("name", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), r.alias("raw")) for m, r in raw.items()))).alias("r")).select("name", "r.*")
    all_ = Window.partitionBy("method")  # a row per factor
    return rows.select("name", "method", F.when(F.sum("raw").over(all_) > 0, F.col("raw") / F.sum("raw").over(all_)).otherwise(1 / F.count("*").over(all_)).alias("weight"))


def weighted_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Return per method and date of factors held at its weights."""
    return returns.join(F.broadcast(weights), "name").groupBy("method", "date_").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))  # five rows per factor


def strategies(returns: DataFrame, by: str = "method", periods: int = 252) -> DataFrame:
    """Growth, risk, ratio, deepest fall, and rank by ratio of every strategy ``(by, date_, ret)``."""
    so_far = Window.partitionBy(by).orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.where("ret > -1").withColumn("__w", F.exp(F.sum(F.log1p("ret")).over(so_far)))
    rows = rows.withColumn("__dd", F.col("__w") / F.greatest(F.max("__w").over(so_far), F.lit(1.0)) - 1)
    root = float(periods) ** 0.5
    out = rows.groupBy(by).agg(
        (F.exp(F.avg(F.log1p("ret")) * periods) - 1).alias("growth"), (F.stddev_pop("ret") * root).alias("volatility"), (F.try_divide(F.avg("ret"), F.stddev_pop("ret")) * root).alias("sharpe"), F.min("__dd").alias("drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate")
    )
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("sharpe").desc_nulls_last(), by)))  # a row per strategy


def scored(table: DataFrame, weights: dict[str, tuple[float, float]], name: str = "score") -> DataFrame:
    """A score of 0 to 100: each metric's part of what counts as full marks, cut at 0 and 1, by its weight."""
    total = sum(w for w, _ in weights.values())
    parts = (F.coalesce(F.least(F.greatest(F.col(m) / full, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) * w for m, (w, full) in weights.items())
    return table.withColumn(name, sum(parts, F.lit(0.0)) * (100.0 / total))


def return_correlations(returns: DataFrame, by: str, names: Sequence[str]) -> DataFrame:
    """Correlation of every two return series, by a pivot to columns of the stated names."""
    wide = returns.groupBy("date_").pivot(by, list(names)).agg(F.first("ret"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = wide.agg(*(corr_of(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs))).alias("r")).select("r.*")


# -- limits of trading ------------------------------------------------------


@dataclass(frozen=True)
class Tradeable:
    """What a row must have to be traded; None leaves a rule out."""

    min_price: float | None = None
    min_volume: float | None = None
    min_value: float | None = None
    min_cap: float | None = None
    window: int = 20
    min_codes: int = 0


def tradeable(panel: DataFrame, rules: Tradeable) -> DataFrame:
    """The panel with ``eligible``: a price above zero, and mean volume, value and size of the last rows above their limits."""
    w = Window.partitionBy("code").orderBy("date_").rowsBetween(-(rules.window - 1), 0)
    test = (F.col("close") > 0) & (F.col("volume") > 0)
    if rules.min_price is not None:
        test &= F.col("close") >= rules.min_price
    for bound, x in ((rules.min_volume, F.col("volume")), (rules.min_value, F.col("close") * F.col("volume")), (rules.min_cap, F.col("cap"))):
        if bound is not None:
            test &= F.avg(x).over(w) >= bound
    out = panel.withColumn("eligible", F.coalesce(test, F.lit(False)))
    if rules.min_codes > 1:
        n = F.sum(F.col("eligible").cast("int")).over(Window.partitionBy("date_"))
        out = out.withColumn("eligible", F.col("eligible") & (n >= rules.min_codes))
    return out


def eligible_counts(mask: DataFrame) -> DataFrame:
    n = F.sum(F.col("eligible").cast("int"))
    return mask.groupBy("date_").agg(n.alias("eligible"), F.count("*").alias("universe"), (n / F.count("*")).alias("share"))


def masked_scores(scores: DataFrame, mask: DataFrame, column: str = "score") -> DataFrame:
    """Scores of rows that may be traded; the others have none."""
    ok = mask.select("date_", "code", "eligible")
    return scores.join(ok, ["date_", "code"], "left").withColumn(column, F.when(F.coalesce("eligible", F.lit(False)), F.col(column))).drop("eligible")


def limited(weights: DataFrame, cap: float, group_cap: float, group: str = "industry", rounds: int = 60) -> DataFrame:
    """Weights of each date's long side with no name above ``cap`` and no group above ``group_cap``.

    What is cut off goes to the others in proportion, round after round, as far as the limits allow; the sum falls
    short where they don't. One date's book is one task's group: as many rows as codes are held.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = part.copy()
        w = out["weight"].clip(lower=0.0).astype(float)
        target = float(w.sum())
        for _ in range(rounds if target > 0 else 0):
            w = w.clip(upper=cap * target)
            sums = w.groupby(out[group]).transform("sum")
            w = w.where(sums <= group_cap * target, w * (group_cap * target) / sums)
            sums = w.groupby(out[group]).transform("sum")
            free = w.where((w < cap * target - 1e-12) & (sums < group_cap * target - 1e-12), 0.0)
            short = target - float(w.sum())
            if short <= 1e-12 or free.sum() <= 0:
                break
            w = w + free * (short / float(free.sum()))
        w = w.clip(upper=cap * target)
        sums = w.groupby(out[group]).transform("sum")
        out["weight"] = w.where(sums <= group_cap * target, w * (group_cap * target) / sums)
        return out

    return weights.select("date_", "code", group, "weight").groupBy("date_").applyInPandas(run, weights.select("date_", "code", group, "weight").schema)


# -- trades -----------------------------------------------------------------


def transactions(positions: DataFrame, prices: DataFrame, capital: float = 1e6) -> DataFrame:
    """Shares bought and sold per date so that a capital is held at the weights; the first date buys all."""
    w = Window.partitionBy("code").orderBy("date_")
    rows = prices.select("date_", "code", "close").join(positions.select("date_", "code", "weight"), ["date_", "code"], "left")
    rows = rows.withColumn("shares", F.coalesce(F.try_divide(F.col("weight") * capital, F.col("close")), F.lit(0.0)))
    rows = rows.withColumn("amount", F.col("shares") - F.coalesce(F.lag("shares").over(w), F.lit(0.0))).where(F.abs("amount") > 1e-12)
    return rows.select("date_", "code", "amount", F.col("close").alias("price"), (-F.col("amount") * F.col("close")).alias("dollars"))


def round_trips(trades: DataFrame) -> DataFrame:
    """First-in, first-out matches of opening and closing trades, without a loop over lots.

    Signed amounts of a code add up to its holding. A holding is cut at zero, so that each piece of a trade either
    opens or closes. On each side, pieces lie end to end on a line of shares; the k-th share opened is the
    k-th closed, so the round trips are where the intervals of both lines overlap: a join on buckets of
    the line would do for any size; here both sides' cut points are merged by one sorted window per code.
    """
    by_time = Window.partitionBy("code").orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)
    t = trades.where(F.abs("amount") > 1e-12).withColumn("after", F.sum("amount").over(by_time))
    t = t.withColumn("before", F.col("after") - F.col("amount"))
    # of a trade against the holding, as much closes as there is; the rest opens on the other side
    closes = F.when(F.col("before") * F.col("amount") < 0, F.least(F.abs("amount"), F.abs("before"))).otherwise(0.0)
    t = t.withColumn("closes", closes).withColumn("opens", F.abs("amount") - F.col("closes"))
    piece = lambda kind, side, size: F.struct(F.lit(kind).alias("kind"), side.alias("side"), size.alias("size"))
    pieces = t.select("code", "date_", "price", F.explode(F.array(piece("close", F.signum("before"), F.col("closes")), piece("open", F.signum("amount"), F.col("opens")))).alias("p")).select("code", "date_", "price", "p.*").where("size > 1e-12")
    line = Window.partitionBy("code", "side", "kind").orderBy("date_").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("to", F.round(F.sum("size").over(line), 6))
    # at every cut point of either line ends one stretch, opened by the first opening and closed by the first closing that reach it
    reach = Window.partitionBy("code", "side").orderBy("to", "date_").rowsBetween(0, Window.unboundedFollowing)
    side = lambda kind: F.first(F.when(F.col("kind") == kind, F.struct("date_", "price")), True).over(reach)
    cut = Window.partitionBy("code", "side").orderBy("to", "date_")
    stretches = pieces.select("code", "side", "to", "date_", side("open").alias("o"), side("close").alias("c"), F.lag("to", 1, 0.0).over(cut).alias("from"))
    whole = stretches.where("o is not null and c is not null and to > from").withColumn("amount", F.col("to") - F.col("from"))
    pnl = F.col("amount") * F.col("side") * (F.col("c.price") - F.col("o.price"))
    return whole.select(
        "code", F.col("o.date_").alias("open_date"), F.col("c.date_").alias("close_date"), (F.col("side") > 0).alias("long"), "amount", F.col("o.price").alias("open_price"), F.col("c.price").alias("close_price"),
        pnl.alias("pnl"), (pnl / (F.col("amount") * F.col("o.price"))).alias("returned"), F.datediff("c.date_", "o.date_").alias("days"),
    )
