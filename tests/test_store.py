"""The store's filters, moves, sections and reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.sources.store import DatasetSpec, Store, long_factor, write_report


def test_filters_moves_sections_and_reports(spark, tmp_path):
    rows = [(dt.date(2024, 1 + i % 3, 1 + i % 28), f"c{i % 5}", float(i)) for i in range(60)]
    store, old, new = Store(spark, f"file://{tmp_path}/s"), DatasetSpec("a"), DatasetSpec("b", group="Other Group")
    store.write(old, long_factor(spark.createDataFrame(rows, "date_ date, code string, x double"), "x"))
    assert store.read(old, filters=[lambda d: d["value"] > 50, lambda d: F.col("code") != "c1"]).count() == sum(x > 50 and c != "c1" for _, c, x in rows)
    store.move(old, new)
    assert store.read(new).count() == 60 and new.path("r") == "r/factor/local/us/stock/1d/other_group/b"
    store.write(old, long_factor(spark.createDataFrame(rows[:1], "date_ date, code string, x double"), "x"))
    with pytest.raises(FileExistsError):
        store.move(old, new)
    table = spark.createDataFrame([("f", 1.0)], "name string, score double")
    store.write_section("My Factor", "Summary", table)
    assert store.read_section("my factor", "summary").collect() == table.collect()
    write_report(table, f"file://{tmp_path}/report")
    write_report(table, f"file://{tmp_path}/lines", "json")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/report").columns == ["name", "score"] and spark.read.json(f"file://{tmp_path}/lines").count() == 1
