"""Front ends: pipelines, research frames, definitions, rankings."""

import datetime as dt

import numpy as np
import pytest

from quantloom.engine import pipeline, ranking, research
from quantloom.functions.dsl import call, col


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def prices(spark, days=30, codes=("A", "B", "C")):
    rows = [(day(i), c, 10.0 + i + k * 3 + (i * 7 + k * 5) % 4, 100.0 * (k + 1)) for k, c in enumerate(codes) for i in range(days)]
    return spark.createDataFrame(rows, "date_ date, code string, close double, volume double")


def test_pipeline_screens_the_output_and_not_the_windows(spark):
    frame = prices(spark)
    data = pipeline.Dataset("price", frame)
    made = pipeline.Pipeline({"mean": pipeline.moving_average(data["close"], 5)}, screen=data["volume"] > 150.0)
    got = pipeline.run_pipeline(made, data, start=day(10), end=day(20)).toPandas()
    assert set(got["code"]) == {"B", "C"} and got["date_"].min() == day(10) and got["date_"].max() == day(20)
    close = frame.toPandas().set_index(["code", "date_"])["close"]
    own = got.set_index(["code", "date_"])["mean"]
    assert own["B", day(10)] == pytest.approx(np.mean([close["B", day(i)] for i in range(6, 11)]))  # the window reaches before the start
    with pytest.raises(KeyError):
        data["nothing"]
    with pytest.raises(KeyError):
        made.add("mean", data["close"])


def test_custom_factor_sees_whole_windows_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(pipeline, "CHUNK", 4)
    frame = prices(spark, 25)
    data = pipeline.Dataset("price", frame)
    made = pipeline.Pipeline().add("x", pipeline.CustomFactor((data["close"], data["volume"]), 6, lambda today, codes, c, v: c[0] + c.sum(axis=0) * v[-1] + len(codes)))
    got = pipeline.run_pipeline(made, data).toPandas().set_index(["code", "date_"])["x"]
    close = frame.toPandas().set_index(["code", "date_"])["close"]
    for k, c in enumerate("ABC"):
        for i in range(25):
            value = got[c, day(i)]
            if i < 5:
                assert np.isnan(value)
            else:
                window = [close[c, day(j)] for j in range(i - 5, i + 1)]
                assert value == pytest.approx(window[0] + sum(window) * 100.0 * (k + 1) + 3)


def test_dataset_rows_of_one_key_and_fill(spark):
    rows = [(day(0), "A", 1.0, 1), (day(0), "A", 2.0, 2), (day(3), "A", 5.0, 1)]
    slow = pipeline.Dataset("slow", spark.createDataFrame(rows, "date_ date, code string, x double, seq int"), order=("seq",), fill=True)
    fast = pipeline.Dataset("fast", prices(spark, 5, ("A",)))
    got = pipeline.run_pipeline(pipeline.Pipeline({"x": slow["x"]}), fast, slow).toPandas().sort_values("date_")["x"].tolist()
    assert got == [2.0, 2.0, 2.0, 5.0, 5.0]


def frame(spark):
    macro = spark.createDataFrame([(day(0), 1.0), (day(5), 2.0)], "date_ date, rate double")
    filed = spark.createDataFrame([(day(2), "A", 7.0), (day(8), "A", 9.0)], "date_ date, code string, book double")
    labels = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "x")], "code string, label string")
    return research.Research().feed_price(prices(spark, 12)).feed_macro(macro).feed_financial(filed).add_classifier("side", labels)


def test_research_feeds_are_known_in_time(spark):
    r = frame(spark).add_factors({"rate": lambda f: f.macro("rate"), "book": lambda f: f.financial("book")})
    got = r.run(["class__side"]).toPandas().set_index(["code", "date_"])
    assert [got.loc[("A", day(i)), "rate"] for i in (0, 4, 5, 11)] == [1.0, 1.0, 2.0, 2.0]
    book = [got.loc[("A", day(i)), "book"] for i in range(12)]
    assert np.isnan(book[2]) and book[3] == 7.0 and book[8] == 7.0 and book[9] == 9.0  # a session after the filing
    assert got.loc[("B", day(3)), "class__side"] == "y" and np.isnan(got.loc[("B", day(9)), "book"])


def test_research_screens(spark):
    r = frame(spark).add_screen("big", lambda f: f.price("volume") >= 200.0).add_factor("lag", call("delay", col("price__close"), 1))
    out = r.run().toPandas()
    assert set(out["code"]) == {"B", "C"} and {x.code for x in r.codes_that_pass().collect()} == {"B", "C"}
    late = frame(spark).add_screen("late", lambda f: f.macro("rate") > 1.5).add_factor("lag", call("delay", col("price__close"), 1))
    after, before = late.run().toPandas(), research.replace(late, screen_first=True).run().toPandas()
    assert after["lag"].notna().all() and before.sort_values("date_").groupby("code").head(1)["lag"].isna().all() and len(after) == len(before)


def test_research_names(spark):
    r = frame(spark)
    with pytest.raises(KeyError, match="did you mean price"):
        r.column("prise", "close")
    with pytest.raises(KeyError):
        r.feed_price(prices(spark))
    with pytest.raises(KeyError):
        r.add_factor("a", col("price__close")).add_factor("a", col("price__close"))
    assert [f.name for f in r.of_kind("macro")] == ["macro"]
    registry = research.Registry()
    made = research.template("m", lambda n=3: lambda x: call("ts_mean", x, n))(n=4)
    registry.register(made)
    assert registry.get("m_n4") is made and registry.names() == ["m_n4"]
    with pytest.raises(KeyError, match="near: m_n4"):
        registry.get("m_n5")
    with pytest.raises(KeyError):
        registry.register(made)
    got = r.add_definition(made).run().toPandas().sort_values(["code", "date_"])
    assert got[got["code"] == "A"]["m_n4"].isna().sum() == 3


def test_ranking_learns_the_factor_that_ranks(spark):
    r = np.random.default_rng(3)
    rows = []
    for d in range(12):
        good, noise = r.normal(0, 1, 15), r.normal(0, 1, 15)
        rows += [(day(d), f"c{i}", float(good[i]), float(noise[i]), float(good[i] + r.normal(0, 0.3))) for i in range(15)]
    frame = spark.createDataFrame(rows, "date_ date, code string, good double, noise double, fwd double")
    for loss in ("pairwise", "listwise"):
        w = ranking.fit(frame, ["good", "noise"], "fwd", loss=loss, rounds=4)
        assert w["good"] > 5 * abs(w["noise"]) > 0 or abs(w["noise"]) < 0.05 < w["good"]
    w = ranking.ic_weights(frame, ["good", "noise"], "fwd")
    assert w["good"] > 0.7
    best = ranking.select(ranking.predict(frame, w), 3)
    assert best.groupBy("date_").count().where("count <> 3").count() == 0
    assert ranking.fit(frame.limit(0), ["good"], "fwd", rounds=2) == {"good": 0.0}
