"""Datasets of long factors on Parquet: month partitions, upserts, pruned reads, many-factor joins."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DatasetSpec:
    """Identity of a dataset; names are lower case without blanks."""

    table: str
    kind: str = "factor"
    provider: str = "local"
    region: str = "us"
    sec_type: str = "stock"
    freq: str = "1d"
    group: str | None = None
    variant: str | None = None

    def path(self, root: str) -> str:
        clean = [re.sub(r"[^a-z0-9_]+", "_", p.strip().lower()) for p in (self.kind, self.provider, self.region, self.sec_type, self.freq, *([self.group] if self.group else []))]
        name = re.sub(r"[^a-z0-9_]+", "_", self.table.strip().lower()) + (f"__{self.variant.strip().lower()}" if self.variant else "")
        return "/".join([root.rstrip("/"), *clean, name])


def long_factor(df: DataFrame, value: str, date: str = "date_", code: str = "code") -> DataFrame:
    """``code, date_, value`` with text codes, double values, and no missing values."""
    x = F.col(value).cast("double")
    out = df.select(F.col(code).cast("string").alias("code"), F.col(date).cast("timestamp").alias("date_"), F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x).alias("value"))
    return out.where("value is not null and code is not null and date_ is not null")


#: Files of a month at most, by codes.
MONTH_FILES = 8


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt by month and a part of the codes, so that a large month is written by several tasks."""
    return df.repartition("month", F.pmod(F.xxhash64("code"), F.lit(MONTH_FILES)))


class Store:
    """Datasets below a root folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def write(self, spec: DatasetSpec, df: DataFrame, *, force: bool = False) -> None:
        """Write a new dataset partitioned by month; an existing one only by force."""
        path = spec.path(self.root)
        if self._exists(path) and not force:
            raise FileExistsError(path)
        dealt(df.withColumn("month", F.date_format("date_", "yyyy-MM"))).write.mode("overwrite").partitionBy("month").parquet(path)

    def upsert(self, spec: DatasetSpec, df: DataFrame) -> None:
        """Merge rows by (code, date_): the last value that is there wins, column by column.

        Only the months that the new rows touch are read and written again.
        """
        path = spec.path(self.root)
        new = df.withColumn("month", F.date_format("date_", "yyyy-MM")).withColumn("__late", F.lit(1))
        if not self._exists(path):
            return self.write(spec, df)
        old = self.spark.read.parquet(path)
        touched = new.select("month").distinct()
        values = [c for c in old.columns if c not in ("code", "date_", "month")]
        both = old.join(touched, "month", "left_semi").withColumn("__late", F.lit(0)).unionByName(new, allowMissingColumns=True)
        last = both.groupBy("code", "date_", "month").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__late"))).alias(c) for c in values))
        merged = last.select("code", "date_", *values, "month")
        # the months are written beside the dataset first: a partition can't be read and replaced in one go
        staged = f"{path}__staged"
        dealt(merged).write.mode("overwrite").partitionBy("month").parquet(staged)
        fresh = self.spark.read.schema(merged.schema).parquet(staged)
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return None

    def read(self, spec: DatasetSpec, *, start: str | None = None, end: str | None = None, codes: Sequence[str] | None = None, low: float | None = None, high: float | None = None, columns: Sequence[str] | None = None, filters: Sequence[Callable[[DataFrame], Column]] = ()) -> DataFrame:
        """Rows of a range of dates that pass all filters; months are pruned, the rest is pushed into the scan."""
        df = self.spark.read.parquet(spec.path(self.root))
        tests: list[Column] = []
        if start:
            tests += [F.col("month") >= start[:7], F.col("date_") >= F.lit(start).cast("timestamp")]
        if end:
            tests += [F.col("month") <= end[:7], F.col("date_") <= F.lit(end).cast("timestamp")]
        if codes is not None:
            tests.append(F.col("code").isin(list(codes)))
        if low is not None:
            tests.append(F.col("value") >= low)
        if high is not None:
            tests.append(F.col("value") <= high)
        tests += [f(df) for f in filters]
        df = reduce(lambda d, t: d.where(t), tests, df)
        return df.select(*(columns or [c for c in df.columns if c != "month"]))

    def factors(self, specs: dict[str, DatasetSpec], how: str = "inner", **where) -> DataFrame:
        """Many factors side by side on (code, date_); outer joins keep the keys of all."""
        frames = [self.read(s, **where).select("code", "date_", F.col("value").alias(name)) for name, s in specs.items()]
        return reduce(lambda a, b: a.join(b, ["code", "date_"], how), frames)

    def move(self, old: DatasetSpec, new: DatasetSpec) -> None:
        """Give a dataset another identity; a rename within one file system."""
        jvm = self.spark._jvm
        source, target = (jvm.org.apache.hadoop.fs.Path(s.path(self.root)) for s in (old, new))
        fs = source.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(target):
            raise FileExistsError(str(target))
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"{source} could not be moved to {target}")

    def section(self, factor: str, name: str) -> str:
        """Folder of one section of a factor's evaluation."""
        clean = lambda x: re.sub(r"[^a-z0-9_]+", "_", x.strip().lower())
        return f"{self.root.rstrip('/')}/evaluation/{clean(factor)}/{clean(name)}"

    def write_section(self, factor: str, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.section(factor, name))

    def read_section(self, factor: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.section(factor, name))

    def manifest(self, spec: DatasetSpec) -> dict:
        df = self.spark.read.parquet(spec.path(self.root))
        row = df.agg(F.count("*").alias("rows"), F.min("date_").alias("start"), F.max("date_").alias("end"), F.count_distinct("code").alias("codes"), F.count_distinct("month").alias("files")).first()
        return {k: str(v) if k in ("start", "end") else v for k, v in row.asDict().items()}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by the path's ending."""
    low = path.lower()
    if low.endswith((".parquet", ".pq")):
        return spark.read.option("mergeSchema", "true").parquet(path)
    if low.endswith(".csv"):
        return spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    raise ValueError(f"neither Parquet nor CSV: {path}")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of a list file, one a line; what follows # is a comment."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(F.regexp_extract(line, r"^[^,]*", 0).alias("name")).where("name <> ''")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """One file of a table that is a report: as CSV with names, or a line of JSON per row."""
    out = df.coalesce(1).write.mode("overwrite")
    out.option("header", "true").csv(path) if kind == "csv" else out.json(path)
