"""Alignment, store, streaming, inference and preparation on small frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import align, inference, portfolio, prepare
from quantloom.sources.store import DatasetSpec, Store, long_factor, read_any, read_names
from quantloom.streaming.bars import bars, snapshots, tick_sink


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_asof_takes_last_known_event(spark):
    panel = spark.createDataFrame([(day(d), c) for d in (0, 2, 4, 6) for c in "AB"], "date_ date, code string")
    events = spark.createDataFrame([(day(1), "A", 1.0, 1), (day(2), "A", 2.0, 2), (day(2), "A", 3.0, 1), (day(9), "A", 9.0, 1), (day(0), "B", None, 1)], "date_ date, code string, v double, k int")
    got = {(r.code, r.date_): r.v for r in align.asof(panel, events, ["v"], order=["k"]).collect()}
    assert [got["A", day(d)] for d in (0, 2, 4, 6)] == [None, 2.0, 2.0, 2.0]
    lagged = {(r.code, r.date_): r.v for r in align.asof(panel, events, ["v"], lag=1, order=["k"]).collect()}
    assert [lagged["A", day(d)] for d in (0, 2, 4, 6)] == [None, None, 2.0, 2.0]
    assert all(v is None for (c, _), v in got.items() if c == "B") and len(got) == 8


def test_lag_sessions_and_holding(spark):
    calendar = align.sessions(spark.createDataFrame([(day(d),) for d in (0, 1, 4, 5)], "date_ date"))
    feed = spark.createDataFrame([(day(0), 1), (day(2), 2), (day(5), 3), (day(9), 4)], "date_ date, v int")
    assert {(r.date_, r.v) for r in align.lag_sessions(feed, calendar, 1).collect()} == {(day(1), 1), (day(5), 2)}
    daily = spark.createDataFrame([(day(d), "A") for d in range(6)], "date_ date, code string")
    marks = spark.createDataFrame([(day(1),), (day(3),)], "date_ date")
    assert {r.date_: r.rebalance for r in align.holding(daily, marks).collect()} == {day(2): day(1), day(3): day(1), day(4): day(3), day(5): day(3)}


def test_dense_has_all_cells(spark):
    df = spark.createDataFrame([(day(0), "A", 1.0), (day(1), "B", 2.0)], "date_ date, code string, v double")
    assert {(r.date_, r.code, r.v) for r in align.dense(df).collect()} == {(day(0), "A", 1.0), (day(1), "A", None), (day(0), "B", None), (day(1), "B", 2.0)}


def test_store_round_trip_and_upsert(spark, tmp_path):
    store, spec = Store(spark, f"file://{tmp_path}"), DatasetSpec("My Factor", variant="v1")
    assert spec.path("/x").endswith("factor/local/us/stock/1d/my_factor__v1")
    raw = spark.createDataFrame([("A", dt.datetime(2024, 1, 5), 1.0), ("A", dt.datetime(2024, 2, 5), 2.0), ("B", dt.datetime(2024, 3, 5), float("nan"))], "code string, date_ timestamp, value double")
    first = long_factor(raw, "value")
    store.write(spec, first)
    with pytest.raises(FileExistsError):
        store.write(spec, first)
    store.upsert(spec, spark.createDataFrame([("A", dt.datetime(2024, 2, 5), 5.0), ("C", dt.datetime(2024, 4, 1), 7.0)], first.schema))
    got = {(r.code, r.date_.month, r.value) for r in store.read(spec).collect()}
    assert got == {("A", 1, 1.0), ("A", 2, 5.0), ("C", 4, 7.0)}
    part = store.read(spec, start="2024-02-01", end="2024-04-30", codes=["A"])
    assert [r.value for r in part.collect()] == [5.0]
    assert "PartitionFilters: [isnotnull(month" in part._jdf.queryExecution().executedPlan().toString()
    assert store.manifest(spec)["rows"] == 3
    other = DatasetSpec("other")
    store.write(other, spark.createDataFrame([("C", dt.datetime(2024, 4, 1), 1.0), ("D", dt.datetime(2024, 4, 1), 2.0)], first.schema))
    both = store.factors({"a": spec, "b": other}, "full").collect()
    assert len(both) == 4 and all(r.code is not None for r in both)


def test_readers_by_ending(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "names.txt").write_text("GDP # output\n\n# all\nCPI,x\n")
    assert read_any(spark, str(tmp_path / "x.csv")).first().b == 2
    assert [r.name for r in read_names(spark, str(tmp_path / "names.txt")).collect()] == ["GDP", "CPI"]
    with pytest.raises(ValueError):
        read_any(spark, "x.xls")


TICKS = "code string, ts timestamp, seq long, price double, size long"


def some_ticks(n=200):
    r = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    return [(r.choice("AB"), start + dt.timedelta(seconds=37 * i), i, r.random(), 1) for i in range(n)]


def test_stream_of_bars_equals_batch(spark, tmp_path):
    ticks = spark.createDataFrame(some_ticks(), TICKS)
    ticks.write.parquet(f"{tmp_path}/in")
    stream = bars(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in"), "10 minutes", watermark="1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bars_out").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.sql("select * from bars_out").collect()) == sorted(bars(ticks, "10 minutes").collect())


def test_snapshots_hold_bounded_state(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 1, i), 1.0, 2.0 + i, 1.0, 1.0 + i, 5, 1) for i in range(5)]
    spark.createDataFrame(rows, "code string, start timestamp, open double, high double, low double, close double, volume long, n long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = snapshots(stream, 3).writeStream.outputMode("update").format("memory").queryName("snap_out").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("select * from snap_out").first()
    assert r.bars == 3 and r.ret == pytest.approx(5 / 3 - 1) and r.amplitude == pytest.approx(5.0)


def test_tick_sink_partitions(spark, tmp_path):
    ticks = spark.createDataFrame(some_ticks(50), TICKS).withColumn("symbol", F.col("code")).withColumn("trade_date", F.to_date("ts"))
    ticks.write.parquet(f"{tmp_path}/in")
    q = tick_sink(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50 and (tmp_path / "out" / "symbol=A").exists()


def test_corrections_and_selection(spark):
    ps = [0.01, 0.04, 0.03, 0.5]
    tests = spark.createDataFrame([(str(i), p) for i, p in enumerate(ps)], "name string, p double")
    got = {r.name: r for r in inference.corrections(tests).collect()}
    assert got["0"].bonferroni == pytest.approx(0.04) and got["2"].holm == pytest.approx(0.09) and got["1"].holm == pytest.approx(0.09)
    assert got["1"].fdr == pytest.approx(0.04 * 4 / 3) and got["2"].fdr == pytest.approx(0.04 * 4 / 3)
    assert inference.select_independent([("a", 3), ("b", 2), ("c", 1)], {("a", "b"): 0.9, ("a", "c"): 0.1}, 0.5) == ["a", "c"]
    p = spark.range(1).select(inference.normal_p(F.lit(1.96)).alias("p")).first().p
    assert p == pytest.approx(0.05, abs=1e-4)


def test_capped_weights(spark):
    w = spark.createDataFrame([(day(0), c, x) for c, x in (("A", 0.7), ("B", 0.2), ("C", 0.1))], "date_ date, code string, weight double")
    got = {r.code: r.weight for r in portfolio.capped(w, 0.5).collect()}
    assert got["A"] == 0.5 and sum(got.values()) == pytest.approx(1.0) and got["B"] == pytest.approx(2 * got["C"])


def test_preparation(spark):
    df = spark.createDataFrame([(day(0), "A", 1.0), (day(0), "B", None), (day(0), "C", 3.0), (day(0), "D", float("nan"))], "date_ date, code string, v double")
    clean = prepare.clean_numbers(df, ["v"])
    assert {r.code: r.v for r in prepare.impute(clean, "v", "median").collect()} == {"A": 1.0, "B": 2.0, "C": 3.0, "D": 2.0}
    assert {r.code: r.bin for r in prepare.bin_edges(clean, "v", [0.0, 1.0, 3.0]).collect()} == {"A": 0, "B": None, "C": 1, "D": None}
    assert [r.code_1 for r in prepare.one_hot(clean, "code", ["A", "B"]).orderBy("code").collect()] == [0, 1, 0, 0]


def test_resampled_inference():
    values = [0.1, 0.2, 0.15, 0.12, 0.18, None, 0.11, 0.14]
    low, high = inference.bootstrap_interval(values)
    assert 0.1 < low < 0.143 < high < 0.2
    assert inference.permutation_p(values) < 0.05 < inference.permutation_p([0.1, -0.1, 0.05, -0.06])
