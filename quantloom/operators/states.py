"""Market states: features per date, clustered or hidden states, and a factor's behaviour in each.

A state is a label per date. Features and labels have one row per date, whatever the
data's size; models are fitted on the driver from that table, :data:`MOST_DATES` at most, and labels are
joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dates that a model is fitted on.
MOST_DATES = 100_000


def features(prices: DataFrame, window: int = 20, price: str = "close", ret: str = "ret") -> DataFrame:
    """Per date the mean return of all codes, its deviation over the last dates, and the change of the mean price."""
    daily = prices.groupBy("date_").agg(F.avg(ret).alias("market_return"), F.avg(price).alias("__price"))
    w, order = Window.orderBy("date_").rowsBetween(-(window - 1), 0), Window.orderBy("date_")  # a row per date
    vol = F.when(F.count("market_return").over(w) >= window, F.stddev_samp("market_return").over(w))
    return daily.select("date_", "market_return", vol.alias("market_vol"), (F.try_divide(F.col("__price"), F.lag("__price", window).over(order)) - 1).alias("market_momentum"))


def simple_states(prices: DataFrame, trend: int = 50, risk: int = 20) -> DataFrame:
    """Four states of each code's days: price above or below its mean, deviation above or below its median."""
    order = Window.partitionBy("code").orderBy("date_")
    long, short = order.rowsBetween(-(trend - 1), 0), order.rowsBetween(-(risk - 1), 0)
    mean = F.when(F.count("close").over(long) >= trend, F.avg("close").over(long))
    vol = F.when(F.count("ret").over(short) >= risk, F.stddev_samp("ret").over(short))
    rows = prices.select("date_", "code", "close", mean.alias("__mean"), vol.alias("__vol"))
    rows = rows.withColumn("__mid", F.percentile("__vol", 0.5).over(Window.partitionBy("code")))
    up, calm = F.col("close") >= F.col("__mean"), F.col("__vol") <= F.col("__mid")
    state = F.when(up & calm, "bull_calm").when(up & ~calm, "bull_wild").when(~up & calm, "bear_calm").when(~up & ~calm, "bear_wild")
    return rows.select("date_", "code", state.alias("state"))


def _matrix(table: DataFrame, columns: Sequence[str]) -> tuple[list, np.ndarray]:
    """Dates with all features, in order, and the standardised features."""
    rows = table.select("date_", *columns).dropna().orderBy("date_").limit(MOST_DATES + 1).collect()
    if len(rows) > MOST_DATES:
        raise ValueError(f"more than {MOST_DATES} dates")
    x = np.array([[r[c] for c in columns] for r in rows], float).reshape(len(rows), len(columns))
    sd = x.std(axis=0) if len(x) else np.ones(len(columns))
    return [r["date_"] for r in rows], (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0) if len(x) else x


def _names(labels: np.ndarray, order: np.ndarray, k: int) -> list[str]:
    """Names of states in the rising order of a feature's mean."""
    names = {2: ["bear", "bull"], 3: ["bear", "sideways", "bull"]}.get(k, [f"state_{i + 1}" for i in range(k)])
    means = [order[labels == s].mean() if (labels == s).any() else np.inf for s in range(k)]
    place = {s: n for n, s in enumerate(np.argsort(means, kind="stable").tolist())}
    return [names[place[s]] for s in labels.tolist()]


def _labelled(table: DataFrame, dates: list, names: list[str]) -> DataFrame:
    kind = table.schema["date_"].dataType.simpleString()
    return table.sparkSession.createDataFrame(list(zip(dates, names, strict=True)), f"date_ {kind}, state string")


def kmeans(x: np.ndarray, k: int, seed: int = 42, starts: int = 10, rounds: int = 100) -> np.ndarray:
    """Labels of the best of several runs of Lloyd's algorithm from spread-out centres."""
    rng = np.random.default_rng(seed)
    best, labels = np.inf, np.zeros(len(x), int)
    for _ in range(starts if len(x) >= k else 0):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            far = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))]])
        own = np.zeros(len(x), int)
        for step in range(rounds):
            new = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            if step and (new == own).all():
                break
            own = new
            centres = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(k)])
        cost = ((x - centres[own]) ** 2).sum()
        if cost < best - 1e-12:
            best, labels = cost, own
    return labels


def hidden(x: np.ndarray, k: int, seed: int = 42, rounds: int = 200, tol: float = 1e-6) -> np.ndarray:
    """Most likely path of a hidden Markov chain with normal features, fitted by expectation and maximisation."""
    n, d = x.shape
    if n < 2 * k:
        return np.zeros(n, int)
    labels = kmeans(x, k, seed)
    mean = np.array([x[labels == s].mean(0) if (labels == s).any() else x[s] for s in range(k)])
    cov = np.array([np.cov(x[labels == s].T, bias=True).reshape(d, d) + 1e-3 * np.eye(d) if (labels == s).sum() > d else np.eye(d) for s in range(k)])
    start, move = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1))

    def density() -> np.ndarray:
        out = np.empty((n, k))
        for s in range(k):
            low = np.linalg.cholesky(cov[s])
            z = np.linalg.solve(low, (x - mean[s]).T)
            out[:, s] = -0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * d * np.log(2 * np.pi)
        return out

    before = -np.inf
    for _ in range(rounds):
        logs = density()
        top = logs.max(1, keepdims=True)
        like = np.exp(logs - top)
        ahead, scale = np.empty((n, k)), np.empty(n)
        for t in range(n):
            a = (start if t == 0 else ahead[t - 1] @ move) * like[t]
            scale[t] = a.sum() + 1e-300
            ahead[t] = a / scale[t]
        back = np.ones((n, k))
        for t in range(n - 2, -1, -1):
            back[t] = move @ (like[t + 1] * back[t + 1]) / scale[t + 1]
        share = ahead * back
        share /= share.sum(1, keepdims=True)
        both = np.einsum("ti,ij,tj->ij", ahead[:-1], move, like[1:] * back[1:] / scale[1:, None])
        start, move = share[0], both / both.sum(1, keepdims=True)
        weight = share.sum(0) + 1e-12
        mean = share.T @ x / weight[:, None]
        for s in range(k):
            e = x - mean[s]
            cov[s] = (share[:, s, None] * e).T @ e / weight[s] + 1e-3 * np.eye(d)
        total = float(np.log(scale).sum() + top.sum())
        if abs(total - before) < tol * abs(total):
            break
        before = total
    logs, lmove = density(), np.log(move + 1e-300)
    score, came = np.log(start + 1e-300) + logs[0], np.zeros((n, k), int)
    for t in range(1, n):
        every = score[:, None] + lmove
        came[t] = every.argmax(0)
        score = every.max(0) + logs[t]
    path = np.zeros(n, int)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def state_labels(table: DataFrame, columns: Sequence[str] = ("market_return", "market_vol", "market_momentum"), k: int = 3, method: str = "kmeans", seed: int = 42, order: str = "market_return") -> DataFrame:
    """A state per date; states are named in the rising order of a feature."""
    dates, x = _matrix(table, columns)
    labels = (kmeans if method == "kmeans" else hidden)(x, k, seed) if len(x) else np.zeros(0, int)
    return _labelled(table, dates, _names(labels, x[:, list(columns).index(order)], k) if len(x) else [])


def with_states(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the state of their date; labels are a row per date."""
    return rows.join(F.broadcast(labels), "date_", "left")


def state_summary(labels: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Days and mean features of every state."""
    return table.join(labels, "date_").groupBy("state").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns))


def state_moves(labels: DataFrame) -> DataFrame:
    """How often each state follows another, and the share of the first's followers."""
    pairs = labels.where("state is not null").select(F.lag("state").over(Window.orderBy("date_")).alias("before"), "state").where("before is not null")  # a row per date
    counts = pairs.groupBy("before", "state").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def ic_by_state(ic: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Mean, deviation, ratio and share of positive coefficients in every state."""
    x = F.col(column)
    rows = ic.join(labels, "date_").where("state is not null")
    return rows.groupBy("state").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.try_divide(F.avg(x), F.stddev_samp(x)).alias("ir"), F.avg((x > 0).cast("double")).alias("positive"), F.count(x).alias("n"))


def state_stability(by_state: DataFrame) -> DataFrame:
    """Spread of the states' means, and 1 over one more than it."""
    return by_state.agg(F.stddev_pop("mean").alias("spread"), (1 / (1 + F.stddev_pop("mean"))).alias("stability"), (F.max(F.signum("mean")) == F.min(F.signum("mean"))).cast("int").alias("same_sign"))


def around_changes(ic: DataFrame, column: str, labels: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
    """Mean coefficient in the dates before and after each change of state, and whether its sign turned."""
    order = Window.orderBy("date_")  # a row per date
    x = F.col(column)
    rows = ic.join(labels, "date_").where("state is not null")
    pre, post = F.avg(x).over(order.rowsBetween(-before, -1)), F.avg(x).over(order.rowsBetween(0, after - 1))
    rows = rows.select("date_", "state", F.lag("state").over(order).alias("was"), pre.alias("before"), post.alias("after")).where("was is not null and was <> state")
    return rows.select("*", (F.col("after") - F.col("before")).alias("change"), (F.signum("after") * F.signum("before") < 0).cast("int").alias("turned"))


def latest(by_state: DataFrame, labels: DataFrame) -> DataFrame:
    """The summary of the state of the last date."""
    now = labels.agg(F.max_by("state", "date_").alias("state"))
    return by_state.join(F.broadcast(now), "state", "left_semi")  # one row


def slices(rows: DataFrame, by: Column, agg) -> DataFrame:
    """The same aggregation in every slice of a label; rows without one are left out."""
    return agg(rows.withColumn("slice", by).where("slice is not null"), "slice")
