"""Operators that SQL can't state, against loops and known answers."""

import datetime as dt
import random
from collections import deque

import numpy as np
import pytest

from quantloom.operators import bayes, books, inference, prepare, ratios, selection, states


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


# -- books ------------------------------------------------------------------


def loop_round_trips(rows):
    """First in, first out, lot by lot."""
    out = []
    for code in sorted({r[1] for r in rows}):
        lots = deque()
        for d, _, amount, price in sorted(r for r in rows if r[1] == code):
            side, left = (1 if amount > 0 else -1), abs(amount)
            while left > 1e-9:
                if lots and lots[0][3] != side:
                    size, open_price, open_day, way = lots[0]
                    n = min(size, left)
                    out.append((code, open_day, d, way > 0, round(n, 6), round(n * way * (price - open_price), 6)))
                    lots[0] = (size - n, open_price, open_day, way)
                    if lots[0][0] <= 1e-9:
                        lots.popleft()
                    left -= n
                else:
                    lots.append((left, price, d, side))
                    left = 0
    return sorted(out)


def test_round_trips_match_lots(spark):
    r = random.Random(5)
    rows = [(day(i), code, float(r.choice([-7, -3, -1, 1, 2, 4, 9])), float(r.randint(10, 99))) for code in ("A", "B", "C") for i in range(60)]
    trades = spark.createDataFrame(rows, "date_ date, code string, amount double, price double")
    got = sorted((x.code, x.open_date, x.close_date, x.long, round(x.amount, 6), round(x.pnl, 6)) for x in books.round_trips(trades).collect())
    assert got == loop_round_trips(rows) and len(got) > 100


def test_limited_weights_keep_limits(spark):
    r = random.Random(3)
    rows = [(day(d), f"c{i}", f"g{i % 4}", r.random() ** 3) for d in range(5) for i in range(20)]
    total = {d: sum(x[3] for x in rows if x[0] == d) for d in {x[0] for x in rows}}
    rows = [(d, c, g, w / total[d]) for d, c, g, w in rows]
    weights = spark.createDataFrame(rows, "date_ date, code string, industry string, weight double")
    got = books.limited(weights, 0.1, 0.3).toPandas()
    assert (got["weight"] <= 0.1 + 1e-9).all() and (got.groupby(["date_", "industry"])["weight"].sum() <= 0.3 + 1e-9).all()
    assert np.allclose(got.groupby("date_")["weight"].sum(), 1.0, atol=1e-6)
    tight = books.limited(weights, 0.01, 0.3).toPandas()  # no way to hold all of it
    assert (tight["weight"] <= 0.01 + 1e-9).all() and np.allclose(tight.groupby("date_")["weight"].sum(), 0.2, atol=1e-6)


# -- returns ----------------------------------------------------------------


def test_monte_carlo_is_seeded_and_bounded(spark):
    r = np.random.default_rng(1)
    rows = [(day(i), c, float(x)) for c in ("A", "B") for i, x in enumerate(r.normal(0.001, 0.01, 120))] + [(day(0), "C", None)]
    frame = spark.createDataFrame(rows, "date_ date, code string, ret double")
    first = {x.code: x for x in ratios.monte_carlo(frame, "ret", 120).collect()}
    again = {x.code: x for x in ratios.monte_carlo(frame.repartition(3), "ret", 120).collect()}
    assert first == again and first["C"].sims == 0 and first["C"].cagr_50 is None
    a = first["A"]
    assert a.drawdown_5 <= a.drawdown_50 <= a.drawdown_95 <= 0 and a.cagr_5 < a.cagr_95 and 0 <= a.bust <= 1
    assert a.sharpe_50 == pytest.approx(np.mean([x[2] for x in rows[:120]]) / np.std([x[2] for x in rows[:120]]) * 252**0.5, abs=1.0)


# -- states -----------------------------------------------------------------


def test_states_find_regimes(spark):
    r = np.random.default_rng(2)
    level = np.repeat([0.02, -0.02, 0.0, 0.02], 60)
    x = np.stack([level + r.normal(0, 0.003, 240), np.abs(level) + r.normal(0, 0.001, 240)], 1)
    z = (x - x.mean(0)) / x.std(0)
    for labels in (states.kmeans(z, 3), states.hidden(z, 3)):
        groups = [set(labels[a:b].tolist()) for a, b in ((5, 55), (65, 115), (125, 175))]
        assert all(len(g) <= 2 for g in groups) and np.mean([np.bincount(labels[a:b], minlength=3).max() / (b - a) for a, b in ((0, 60), (60, 120), (120, 180), (180, 240))]) > 0.95
    table = spark.createDataFrame([(day(i), float(a), float(b)) for i, (a, b) in enumerate(x)] + [(day(900), None, 1.0)], "date_ date, market_return double, spread double")
    got = {x.date_: x.state for x in states.state_labels(table, ("market_return", "spread")).collect()}
    assert len(got) == 240 and got[day(10)] == "bull" and got[day(90)] == "bear" and got[day(150)] == "sideways"


def test_hidden_of_few_rows():
    assert states.hidden(np.zeros((3, 2)), 3).tolist() == [0, 0, 0]
    assert states.kmeans(np.zeros((2, 1)), 3).tolist() == [0, 0]


# -- tests ------------------------------------------------------------------


def test_mixture_splits_nulls_from_effects(spark):
    r = np.random.default_rng(4)
    z = np.concatenate([r.normal(0, 1, 800), r.normal(0, 5, 200)])
    pi0, var, null = bayes.mixture(z)
    assert 0.7 < pi0 < 0.9 and 15 < var < 35 and null[np.abs(z) > 6].max() < 0.01 and null[np.abs(z) < 1].min() > 0.5
    tests = spark.createDataFrame([(f"f{i:04d}", "a" if i >= 800 else "b", float(v)) for i, v in enumerate(z)], "name string, family string, z double")
    table = bayes.bayes_table(tests)
    rates = bayes.error_rates(table).first()
    found = {x.name for x in table.where("discovered").collect()}
    assert rates.n == len(found) > 80 and rates.fdr < 0.05 and len([f for f in found if f < "f0800"]) <= 0.1 * len(found)
    families = {x.family: x.group_pi0 for x in bayes.hierarchical_table(tests, "family").collect()}
    assert families["a"] < families["b"]
    assert bayes.bayes_table(tests.limit(0)).count() == 0


def test_local_level_follows_a_shift():
    y = np.concatenate([np.zeros(60), np.full(60, 1.0)]) + np.random.default_rng(0).normal(0, 0.1, 120)
    table = bayes.local_level(y, 0.9)
    assert abs(table[55, 1]) < 0.1 and abs(table[-1, 1] - 1) < 0.15 and (np.diff(table[:, 3]) <= 1e-12).all()


def test_quadratic_against_newey_west(spark):
    r = np.random.default_rng(7)
    x = r.normal(0, 1, 150)
    y = 0.1 + 0.5 * x + 0.3 * x * x + r.normal(0, 0.2, 150)
    frame = spark.createDataFrame([(day(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "date_ date, market double, ret double")
    got = {t.term: t for t in bayes.quadratic(frame, "ret", "market", 4).collect()}
    design = np.column_stack([np.ones(150), x, x * x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    s = design * (y - design @ beta)[:, None]
    meat = s.T @ s + sum((1 - k / 5) * (s[k:].T @ s[:-k] + s[:-k].T @ s[k:]) for k in range(1, 5))
    inverse = np.linalg.inv(design.T @ design)
    error = np.sqrt(np.diag(inverse @ meat @ inverse))
    assert [got[t].estimate for t in ("alpha", "beta", "gamma")] == pytest.approx(beta) and [got[t].error for t in ("alpha", "beta", "gamma")] == pytest.approx(error)
    assert bayes.quadratic(frame.limit(3), "ret", "market").count() == 0


def test_validated_series(spark):
    rows = [("a", day(i), 0.1 + 0.01 * (i % 5)) for i in range(40)] + [("b", day(i), (-1.0) ** i) for i in range(40)] + [("c", day(0), None)]
    got = {x.name: x for x in inference.validated(spark.createDataFrame(rows, "name string, date_ date, v double"), "v", 300).collect()}
    assert got["a"].p < 0.02 and got["a"].low < got["a"].mean < got["a"].high and got["b"].p > 0.5 and got["c"].n == 0


# -- selection --------------------------------------------------------------

M = {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): 0.2, ("a", "d"): 0.1, ("b", "d"): 0.3, ("c", "d"): 0.95}


def test_choices_from_a_matrix():
    scores = {"a": 3.0, "b": 2.0, "c": 1.0, "d": 0.5}
    assert selection.greedy(scores, M) == ["a", "c"] == selection.independent(scores, M)
    assert selection.by_average(scores, M, 0.5) == ["a", "c", "b"][:2] + (["b"] if (0.9 + 0.2) / 2 <= 0.5 else [])
    assert selection.clusters(list("abcd"), M, 0.3) == {"a": 1, "b": 1, "c": 2, "d": 2}
    assert selection.representatives(scores, M, 0.3) == ["a", "c"]
    assert selection.clusters(["x"], {}) == {"x": 1} and selection.greedy({}, {}) == []


def test_gain_prefers_factors_that_diversify(spark):
    r = np.random.default_rng(3)
    base = r.normal(0.001, 0.01, 300)
    rows = [("a", day(i), float(v)) for i, v in enumerate(base)] + [("same", day(i), float(v)) for i, v in enumerate(base * 0.99)] + [("other", day(i), float(v)) for i, v in enumerate(r.normal(0.001, 0.01, 300))]
    got = [n for n, _ in selection.by_gain(spark.createDataFrame(rows, "name string, date_ date, ret double"), ["a", "same", "other"])]
    assert "other" in got and not {"a", "same"} <= set(got)


# -- preparation ------------------------------------------------------------


def test_supervised_bins(spark):
    rows = [(float(i), int(i >= 300)) for i in range(600)]
    frame = spark.createDataFrame(rows, "x double, y int")
    got = {r.x: r.bin for r in prepare.bin_supervised(frame, "x", "y").collect()}
    assert {got[float(i)] for i in range(300)} == {0} and {got[float(i)] for i in range(300, 600)} == {1}
    assert prepare.merge_bins([], 3, 3.8) == [] and prepare.merge_bins([(1.0, 3.0, 3.0), (2.0, 3.0, 3.0)], 5, 3.8) == []


def test_supervised_bins_of_many_values(spark):
    # cuts between any two of the values, the largest among the binned
    rows = [(i / 100, int(i >= 4321)) for i in range(6000)] + [(None, 1), (float("nan"), 1), (1e9, None)]
    got = [(r.x, r.bin) for r in prepare.bin_supervised(spark.createDataFrame(rows, "x double, y int"), "x", "y").collect()]
    assert all(k == int(x >= 43.21) for x, k in got if x is not None and x == x)
    assert [k for x, k in got if x is None or x != x] == [None, None]


def test_merged_bins_are_those_of_a_plain_loop():
    def plain(counts, most, least):
        bins = [[v, v, g, b] for v, g, b in counts]
        while len(bins) > 1:
            value, i = min((prepare.chi_square(*p[2:], *q[2:]), i) for i, (p, q) in enumerate(zip(bins, bins[1:], strict=False)))
            if len(bins) <= most and value >= least:
                break
            low, high = bins[i], bins.pop(i + 1)
            bins[i] = [low[0], high[1], low[2] + high[2], low[3] + high[3]]
        return [(p[1] + q[0]) / 2 for p, q in zip(bins, bins[1:], strict=False)]

    r = np.random.default_rng(5)
    for _ in range(300):
        counts = [(float(i), float(g), float(b)) for i, (g, b) in enumerate(r.integers(0, r.choice([2, 3, 50]), (r.integers(0, 40), 2)))]
        for most, least in ((5, 3.841), (1, 3.8), (3, 0.0), (40, 2.0)):
            assert prepare.merge_bins(counts, most, least) == plain(counts, most, least)
    # so many that outdated pairs are cleared from the heap on the way
    flags = r.random(1500) < 0.4
    counts = [(float(i), float(not f), float(f)) for i, f in enumerate(flags)]
    assert prepare.merge_bins(counts, 5, 3.841) == plain(counts, 5, 3.841)


def test_bins_around_means(spark):
    rows = [(day(0), f"c{i}", x) for i, x in enumerate([1.0, 1.1, 0.9, 5.0, 5.1, 9.0, None])]
    got = {r.code: r.bin for r in prepare.bin_kmeans(spark.createDataFrame(rows, "date_ date, code string, x double"), "x", 3).collect()}
    assert got == {"c0": 0, "c1": 0, "c2": 0, "c3": 1, "c4": 1, "c5": 2, "c6": None}


def test_isolation_flags_what_lies_apart(spark):
    r = np.random.default_rng(9)
    rows = [(day(0), f"c{i}", float(a), float(b)) for i, (a, b) in enumerate(r.normal(0, 1, (80, 2)))] + [(day(0), "far", 9.0, -9.0), (day(0), "none", None, 1.0)]
    got = {x.code: x for x in prepare.isolation(spark.createDataFrame(rows, "date_ date, code string, x double, y double"), ["x", "y"], 0.02).collect()}
    assert got["far"].outlier == 1 and got["none"].outlier == 0 and sum(x.outlier for x in got.values()) <= 3


def test_residual_on_several_exposures(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (30, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + r.normal(0, 0.1, 30)
    frame = spark.createDataFrame([(day(0), f"c{i}", float(y[i]), *map(float, x[i])) for i in range(30)] + [(day(1), "c0", 1.0, 1.0, 1.0, 1.0)], "date_ date, code string, y double, a double, b double, c double")
    got = {q.code: q.residual for q in prepare.orthogonal(frame, "y", ["a", "b", "c"]).collect()}
    design = np.column_stack([np.ones(30), x])
    want = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert len(got) == 30 and all(got[f"c{i}"] == pytest.approx(want[i], abs=1e-9) for i in range(30))


def test_preparer_chain(spark):
    rows = [(day(0), f"c{i}", "g", x) for i, x in enumerate([1.0, 2.0, None, 4.0, 1000.0])]
    out = prepare.Preparer("x", "median", "mad", None, "zscore", 2).transform(spark.createDataFrame(rows, "date_ date, code string, industry string, x double")).toPandas()
    assert abs(out["x"].mean()) < 1e-9 and out["x"].std(ddof=0) == pytest.approx(1.0) and out["x"].notna().all() and set(out["bin"]) == {1.0, 2.0}
