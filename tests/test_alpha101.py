"""Formulas on a small panel, held to published values and to their warm-up rows."""

import datetime
import math
import random
from fractions import Fraction

import pytest

from quantloom.functions import alpha101, gtja191
from quantloom.functions.expr import Frame, lower

ROWS = 320
#: Last values of formulas on the panel below (fixed values).
EXPECTED = {
    1: {"AAA": 0.125, "BBB": 0.125, "CCC": 0.125, "DDD": 0.125},
    48: {"AAA": 0.0, "BBB": 0.0, "CCC": 0.0, "DDD": 0.0},
    69: {"AAA": -0.9491175456, "BBB": -0.9491175456, "CCC": -0.9491175456, "DDD": -0.9491175456},
    80: {"AAA": -0.9246555971, "BBB": -0.9246555971, "CCC": -0.9246555971, "DDD": -0.9246555971},
    82: {"AAA": -0.625, "BBB": -0.625, "CCC": -0.625, "DDD": -0.625},  # equal moves of all codes share a rank; noise in the last bits makes no order here
    89: {"AAA": -0.2833333333, "BBB": -0.2833333333, "CCC": -0.2833333333, "DDD": -0.2833333333},
    101: {"AAA": 0.173837462, "BBB": 0.173837462, "CCC": 0.173837462, "DDD": 0.173837462},
}


def panel(spark):
    rows = []
    for code, base in (("AAA", 100.0), ("BBB", 60.0), ("CCC", 80.0), ("DDD", 120.0)):
        industry = {"AAA": "software", "BBB": "bank", "CCC": "oil", "DDD": "hardware"}[code]
        before = None
        for i in range(ROWS):
            close = base + 0.08 * i + math.sin(i / 7.0) + math.cos(i / 13.0)
            bar = (close - 0.4, close + 1.2, close - 1.1, close)
            rows.append((datetime.date(2024, 1, 1) + datetime.timedelta(days=i), code, *bar, 1_000_000.0 + i * 500 + ord(code[0]), sum(bar) / 4, close / before - 1 if before else None, industry))
            before = close
    return spark.createDataFrame(rows, "date_ date, code string, open double, high double, low double, close double, volume double, vwap double, ret double, industry string").withColumn("cap", __import__("pyspark").sql.functions.expr("close * volume"))


@pytest.fixture(scope="module")
def values(spark):
    wanted = sorted({*EXPECTED, *alpha101.TESTED, 10})
    frame = Frame(classes=(("sector", "industry"), ("industry", "industry"), ("subindustry", "industry")))
    out = lower(panel(spark), {f"a{n}": alpha101.alpha(n) for n in wanted}, frame)
    return out.orderBy("code", "date_").toPandas()


@pytest.mark.parametrize("number", EXPECTED)
def test_published_values(values, number):
    last = values.groupby("code").tail(1).set_index("code")[f"a{number}"]
    for code, want in EXPECTED[number].items():
        assert last[code] == pytest.approx(want, abs=2e-8)


#: Rows of a code before the window of what a formula tests is full.
WARM_UP = {7: 19, 9: 5, 10: 4, 21: 19, 23: 19, 24: 199, 46: 20, 49: 20, 51: 20}


@pytest.mark.parametrize("number", WARM_UP)
def test_no_value_before_the_window_is_full(values, number):
    own = values[values["code"] == "BBB"][f"a{number}"]
    if number == 7:  # its choice needs a longer window yet
        assert own.iloc[:19].isna().all() and own.iloc[80:].notna().all()
    else:
        assert own.isna().tolist() == [i < WARM_UP[number] for i in range(ROWS)]


def cents_panel(spark):
    """Closes in cents that are near those of 20 rows before, or equal; and what formula 45 makes of them in whole numbers."""
    rng, days, codes = random.Random(4), 160, "ABCDE"
    closes = {c: [rng.randrange(100_000, 50_000_000) for _ in range(20)] for c in codes}
    volumes = {c: [rng.randrange(1, 40) for _ in range(days)] for c in codes}
    for c in codes:
        for t in range(20, days):
            closes[c].append(closes[c][t - 20] + rng.choice((-150, -18, -4, 0, 1, 7, 90)))

    def sign(x):
        return (x > 0) - (x < 0)

    def rank(values):
        some = [v for v in values.values() if v is not None]
        return {c: Fraction(2 * sum(w < v for w in some) + sum(w == v for w in some) + 1, 2 * len(some)) for c, v in values.items() if v is not None}

    rows, want = [], {}
    for t in range(days):
        date = datetime.date(2020, 1, 1) + datetime.timedelta(days=t)
        rows += [(date, c, closes[c][t] / 100, float(volumes[c][t])) for c in codes]
        if t < 24:
            continue
        level = rank({c: sum(closes[c][t - 24 : t - 4]) for c in codes})
        slow = rank({c: sign(closes[c][t] - closes[c][t - 5]) * sign(closes[c][t] - closes[c][t - 20]) or None for c in codes})
        for c in codes:
            fast = sign(closes[c][t] - closes[c][t - 1]) * sign(volumes[c][t] - volumes[c][t - 1])
            want[date, c] = float(-level[c] * fast * slow[c]) if fast and c in slow else None
    return spark.createDataFrame(rows, "date_ date, code string, close double, volume double"), want


def test_correlations_of_two_rows_are_whole(spark):
    frame, want = cents_panel(spark)
    got = {(r.date_, r.code): r.f for r in lower(frame, {"f": alpha101.alpha(45)}).collect()}
    assert {k: got[k] for k in want} == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in want.items()}
    assert all(v is None for k, v in got.items() if k not in want) and None in want.values()


def test_formula_113_of_the_second_library_is_whole_too(spark):
    frame, want = cents_panel(spark)
    got = {(r.date_, r.code): r.f for r in lower(frame, {"f": gtja191.alpha(113)}).collect()}
    assert {k: got[k] for k in want} == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in want.items()}
