"""Expressions: planning, parsing, and missing-value rules on a small panel."""

import datetime as dt

import pytest

from quantloom.functions import alpha101, dsl, mined
from quantloom.functions.dsl import call, col, parse
from quantloom.functions.expr import OPS, lower, windowed
from quantloom.functions.render import SQL


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for k, code in enumerate("ABCD"):
        for d in range(12):
            x = None if (d + k) % 5 == 0 else float((d * 7 + k * 3) % 11)
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(days=d), code, "g" + str(k % 2), x, float(d)))
    return spark.createDataFrame(rows, "date_ date, code string, industry string, x double, y double")


def values(panel, expr):
    return {(r.code, r.date_.day): r.f for r in lower(panel, {"f": expr}).collect()}


def series(panel, code):
    return [r.x for r in panel.where(f"code = '{code}'").orderBy("date_").collect()]


def test_every_operator_has_both_forms():
    assert set(OPS) - set(SQL) == set() or set(OPS) - set(SQL) == {"x"}, set(OPS) - set(SQL)


def test_windows_need_full_counts(panel):
    got, xs = values(panel, call("ts_mean", col("x"), 3)), series(panel, "A")
    for i in range(12):
        part = xs[max(0, i - 2) : i + 1]
        want = sum(part) / 3 if len(part) == 3 and None not in part else None
        assert got["A", i + 1] == (pytest.approx(want) if want is not None else None)


def test_rank_shares_ties_and_skips_nulls(panel):
    got = values(panel, call("cs_rank", col("x")))
    for d in range(1, 13):
        xs = {c: series(panel, c)[d - 1] for c in "ABCD"}
        there = [v for v in xs.values() if v is not None]
        for c, v in xs.items():
            want = None if v is None else (sum(o < v for o in there) + (sum(o == v for o in there) + 1) / 2) / len(there)
            assert got[c, d] == (pytest.approx(want) if want is not None else None)


def test_fill_limits(panel):
    got, xs = values(panel, call("ffill", col("x"), 1)), series(panel, "A")
    for i in range(12):
        want = xs[i] if xs[i] is not None else (xs[i - 1] if i else None)
        assert got["A", i + 1] == want


def test_comparisons_of_missing_are_false(panel):
    got, xs = values(panel, call("bool", col("x") < 100.0)), series(panel, "B")
    assert [got["B", i + 1] for i in range(12)] == [0.0 if v is None else 1.0 for v in xs]


def test_division_by_zero_is_null(panel):
    got = values(panel, col("x") / col("y"))
    assert got["B", 1] is None and got["B", 2] is not None


def test_equal_subtrees_are_planned_once():
    x = call("cs_rank", call("delta", col("x"), 1))
    stages = windowed([x + x, call("ts_mean", x, 3)])
    assert [len(s) for s in stages] == [1, 1, 1]


def test_same_partitioning_shares_one_exchange(panel):
    e = {f"m{n}": call("ts_mean", col("x"), n) for n in (2, 3, 4)}
    plan = lower(panel, e)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_parser_precedence_and_errors():
    assert repr(parse("1 + 2 * 3")) == repr(parse("7"))
    assert repr(parse("-x ^ 2")) == repr(-(col("x") ** 2.0))
    with pytest.raises(ValueError):
        parse("rank(x")
    with pytest.raises(AttributeError):
        parse("nosuch(x)")


def test_all_formulas_parse():
    assert len(alpha101.alphas()) == 101


def test_methods_are_operators():
    assert repr(col("x").rank()) == repr(call("cs_rank", col("x")))
    assert repr(col("x").ts_mean(5)) == repr(dsl.call("sma", col("x"), 5))


def test_codes_on_their_line_leave_no_residual_to_rank(spark):
    # bars of two codes a date whose residuals came out as noise, in both orders
    bars = [(212990.64, 1766.0, 16092.55, 1787.0), (52725.19, 1604.0, 441379.55, 1716.0), (68221.13, 757.0, 485200.62, 714.0), (374866.62, 454.0, 198829.51, 434.0), (422422.88, 814.0, 197193.61, 771.0)]
    bars += [(c, d, a, b) for a, b, c, d in bars]
    rows = [(dt.date(2024, 1, k), code, close, volume / 1000) for k, (a, b, c, d) in enumerate(bars, 1) for code, close, volume in (("A", a, b), ("B", c, d))]
    panel = spark.createDataFrame(rows, "date_ date, code string, close double, turn_rate double")
    left = values(panel, parse("cs_regression_residual(close, 1 / turn_rate)"))
    assert set(left.values()) == {0.0} and len(left) == 20
    assert set(values(panel, mined.factor("rank_normalize_log_regression_residual")).values()) == {0.0}


def test_small_residuals_and_missing_sides_stay(spark):
    inf = float("inf")
    days = {1: ((1e5, 0.0), (1e5 + 2e-5, 1.0), (1e5, 2.0)), 2: ((1e5 + 0.1, 0.1), (1e5 + 0.3, 0.3), (1e5 + 0.7, 0.7)), 3: ((1.0, 1.0), (2.0, None), (5.0, 3.0)), 4: ((7.0, None), (8.0, 4.0), (None, 1.0)), 5: ((inf, 1.0), (2.0, 2.0), (3.0, 4.0)), 6: ((0.0, 1.0), (0.0, 2.0), (0.0, 3.0))}
    rows = [(dt.date(2024, 1, d), code, *pair) for d, pairs in days.items() for code, pair in zip("ABC", pairs, strict=True)]
    got = values(spark.createDataFrame(rows, "date_ date, code string, x double, y double"), call("cs_residual", col("x"), col("y")))
    assert [got[c, 1] for c in "ABC"] == pytest.approx([-2e-5 / 3, 4e-5 / 3, -2e-5 / 3], rel=1e-4)
    assert [got[c, 2] for c in "ABC"] == [0.0, 0.0, 0.0]
    assert [got[c, 3] for c in "ABC"] == [0.0, None, 0.0]
    assert [got[c, 4] for c in "ABC"] == [None, 0.0, None]
    assert all(got[c, 5] != got[c, 5] for c in "ABC")
    assert [got[c, 6] for c in "ABC"] == [0.0, 0.0, 0.0]


def test_correlation_of_two_rows(spark):
    rows = [(1, 5e6, 1.0), (2, 5e6 + 0.04, 3.0), (3, 5e6 - 0.06, 2.0), (4, 5e6 - 0.06, 4.0), (5, 5e6 - 0.059999999, 5.0), (6, 1.0, None), (7, 2.0, 1.0), (8, 3.0, 0.0), (9, float("inf"), 5.0), (10, float("nan"), 6.0), (11, 1.0, 7.0), (12, 1.0 + 1e-10, 8.0), (13, 1.0, 9.0)]
    frame = spark.createDataFrame([(dt.date(2024, 1, d), "A", x, y) for d, x, y in rows], "date_ date, code string, x double, y double")
    got = values(frame, call("ts_corr", col("x"), col("y"), 2))
    assert [got["A", d] for d in range(1, 14)] == [None, 1.0, 1.0, None, None, None, None, -1.0, None, None, None, None, None]
