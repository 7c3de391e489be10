"""Queries of the front ends, the store and the streams, each with its SQL where SQL can state it."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.engine import pipeline, ranking, research
from quantloom.functions.dsl import call, col
from quantloom.plans.panels import DAILY_SQL, MONTHLY_SQL, daily, monthly, table
from quantloom.plans.research import ORACLE, query
from quantloom.plans.scoring import NAMES, STACK_SQL, WIDE_SQL, rank_sql, wide
from quantloom.sources.store import DatasetSpec, Store, long_factor
from quantloom.streaming.bars import bars


def folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share: below ``spark.checkpoint.dir``, in local mode else a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset")
        root = "file://" + tempfile.mkdtemp(prefix="quantloom-")
    return f"{root.rstrip('/')}/quantloom-{uuid.uuid4().hex}"


# -- pipelines --------------------------------------------------------------

FROM = dt.date(1996, 1, 1)


def sources(spark, sf_dir) -> tuple[pipeline.Dataset, pipeline.Dataset]:
    panel = daily(spark, sf_dir)
    return pipeline.Dataset("price", panel.select("date_", "code", "open", "close")), pipeline.Dataset("book", panel.where("close > open").select("date_", "code", "volume"), fill=True)


@query(
    f"""WITH p AS (SELECT date_, code, open, close, last_value(CASE WHEN close > open THEN volume END IGNORE NULLS) OVER (PARTITION BY code ORDER BY date_ ROWS UNBOUNDED PRECEDING) AS volume FROM ({DAILY_SQL}) WHERE date_ >= DATE '1996-01-01' - INTERVAL 400 DAY),
        w AS (SELECT *, close / nullif(lag(close, 4) OVER c, 0) - 1 AS ret5, avg(close) OVER (PARTITION BY code ORDER BY date_ ROWS 9 PRECEDING) AS mean10, stddev_pop(close) OVER (PARTITION BY code ORDER BY date_ ROWS 9 PRECEDING) AS dev10 FROM p WINDOW c AS (PARTITION BY code ORDER BY date_)),
        r AS (SELECT *, CASE WHEN ret5 IS NOT NULL THEN row_number() OVER (PARTITION BY date_ ORDER BY round(ret5, 9) DESC NULLS LAST, code) <= 3 ELSE FALSE END AS best FROM w)
        SELECT date_, code, ret5, mean10, dev10, volume FROM r WHERE best AND date_ >= DATE '1996-01-01'""",
    ("ret5", "mean10", "dev10", "volume"),
)
def pipeline_run(spark, sf_dir):
    price, book = sources(spark, sf_dir)
    change = pipeline.returns(price["close"], 5)
    made = pipeline.Pipeline(screen=call("top", change, 3) > 0.0)
    made.add("ret5", change).add("mean10", pipeline.moving_average(price["close"], 10)).add("dev10", pipeline.rolling_deviation(price["close"], 10)).add("volume", book["volume"])
    return pipeline.run_pipeline(made, price, book, start=FROM)


def spread_of_window(today, codes, close):
    """Highest less lowest close of the window, less the same over all codes."""
    with np.errstate(all="ignore"):
        own = np.nanmax(close, axis=0) - np.nanmin(close, axis=0)
    return own - np.nanmean(own)


@query(
    f"""WITH d AS (SELECT date_, row_number() OVER (ORDER BY date_) AS k FROM (SELECT DISTINCT date_ FROM ({MONTHLY_SQL}))), p AS (SELECT m.code, d.k, m.close FROM ({MONTHLY_SQL}) m JOIN d USING (date_)),
        c AS (SELECT DISTINCT code FROM p), g AS (SELECT c.code, d.k, d.date_ FROM c, d), v AS (SELECT g.code, g.date_, g.k, max(p.close) - min(p.close) AS own FROM g LEFT JOIN p ON p.code = g.code AND p.k BETWEEN g.k - 4 AND g.k GROUP BY ALL),
        w AS (SELECT *, own - avg(own) OVER (PARTITION BY date_) AS spread FROM v)
        SELECT m.date_, m.code, CASE WHEN w.k >= 5 THEN w.spread END AS spread FROM w JOIN ({MONTHLY_SQL}) m ON m.date_ = w.date_ AND m.code = w.code""",
    ("spread",),
)
def pipeline_custom(spark, sf_dir):
    data = pipeline.Dataset("price", monthly(spark, sf_dir).select("date_", "code", "close"))
    made = pipeline.Pipeline().add("spread", pipeline.CustomFactor((data["close"],), 5, spread_of_window))
    return pipeline.run_pipeline(made, data)


# -- research frames --------------------------------------------------------


def frame(spark, sf_dir) -> research.Research:
    panel = monthly(spark, sf_dir)
    macro = table(spark, sf_dir, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("date_"), F.col("o_totalprice").cast("double").alias("p")).groupBy("date_").agg(F.avg("p").alias("level"))
    static = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("code"), F.col("n_regionkey").cast("int").alias("region"))
    r = research.Research().feed_price(panel.select("date_", "code", "open", "close", "volume")).feed_macro(macro).feed("static", static, kind="static")
    labels = static.select("code", F.col("region").alias("label"))
    r = r.add_classifier("region", labels).add_screen("liquid", r.price("volume") > 3000.0).add_screen("priced", lambda f: f.price() > 0.0)
    return r.add_factors({"change": call("pct_change", r.price(), 2), "over": lambda f: f.price() / f.macro("level")}).add_definition(research.DEFINITIONS.get("reversal_n5"))


@query(
    f"""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date_, avg(CAST(o_totalprice AS DOUBLE)) AS level FROM orders GROUP BY ALL),
        p AS (SELECT date_, code, volume, close, close / nullif(lag(close, 2) OVER w, 0) - 1 AS change, -(close / nullif(lag(close, 5) OVER w, 0) - 1) AS reversal_n5 FROM ({MONTHLY_SQL}) WINDOW w AS (PARTITION BY code ORDER BY date_))
        SELECT p.date_, p.code, n_regionkey::INTEGER AS class__region, change, close / nullif(level, 0) AS "over", reversal_n5 FROM p JOIN nation ON n_nationkey = p.code LEFT JOIN m ON m.date_ = p.date_ WHERE volume > 3000 AND close > 0""",
    ("change", "over", "reversal_n5"),
)
def research_frame(spark, sf_dir):
    return frame(spark, sf_dir).run(["class__region"])


@query(f"SELECT DISTINCT code FROM ({MONTHLY_SQL}) WHERE volume > 3000 AND close > 0")
def research_codes(spark, sf_dir):
    return frame(spark, sf_dir).codes_that_pass()


@query(
    f"""WITH f AS (SELECT date_, code, last_value(CASE WHEN volume > 5000 THEN cap END IGNORE NULLS) OVER (PARTITION BY code ORDER BY date_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, date_ AS d FROM ({MONTHLY_SQL})),
        s AS (SELECT date_, row_number() OVER (ORDER BY date_) AS k FROM (SELECT DISTINCT date_ FROM ({MONTHLY_SQL}))), e AS (SELECT m.code, s.k + 1 AS k, m.cap FROM ({MONTHLY_SQL}) m JOIN s USING (date_) WHERE m.volume > 5000)
        SELECT m.date_, m.code, m.close / nullif((SELECT max_by(e.cap, e.k) FROM e WHERE e.code = m.code AND e.k <= s.k), 0) AS yield FROM ({MONTHLY_SQL}) m JOIN s ON s.date_ = m.date_""",
    ("yield",),
)
def research_point_in_time(spark, sf_dir):
    panel = monthly(spark, sf_dir)
    r = research.Research().feed_price(panel.select("date_", "code", "close")).feed_financial(panel.where("volume > 5000").select("date_", "code", "cap"))
    return r.add_factor("yield", r.price() / r.financial("cap")).run()


def _part(n: str, how: str) -> str:
    if how == "rank_mean":
        return f"({rank_sql(n, 'date_')}) / count({n}) OVER (PARTITION BY date_)"
    if how == "zscore_mean":
        return f"CASE WHEN stddev_pop({n}) OVER (PARTITION BY date_) > 1e-9 THEN ({n} - avg({n}) OVER (PARTITION BY date_)) / (stddev_pop({n}) OVER (PARTITION BY date_)) END"
    return n


def _group(how: str):
    value = {"median": "list_median(v)", "weighted": "list_sum(v)"}.get(how, "list_sum(v) / len(v)")
    parts = ", ".join(f"({_part(n, how)})" + (f" * {w}" if how == "weighted" else "") for n, w in GROUP.items())

    @query(f"SELECT date_, code, CASE WHEN len(v) > 0 THEN {value} END AS value FROM (SELECT date_, code, list_filter([{parts}], lambda x: x IS NOT NULL) AS v FROM ({WIDE_SQL}))", ("value",))
    def run(spark, sf_dir):
        return research.combined(wide(spark, sf_dir), GROUP, how)

    return run


GROUP = {"momentum": 0.5, "reversal": 0.3, "size": 0.2}


def _register_groups() -> None:
    from quantloom.plans import research as registry

    for how in ("mean", "median", "weighted", "rank_mean", "zscore_mean"):
        _group(how)
        registry.QUERIES[f"group_{how}"] = registry.QUERIES.pop("run")
        registry.ORACLE[f"group_{how}"] = registry.ORACLE.pop("run")


_register_groups()


@query()
def ranking_models(spark, sf_dir):
    """Weights by pairwise and listwise descent and by correlation; fitted, so tested against the descent on one machine."""
    rows = wide(spark, sf_dir).select("date_", "code", *NAMES, "fwd_1")
    found = [(loss, n, w) for loss in ("pairwise", "listwise") for n, w in ranking.fit(rows, NAMES, "fwd_1", loss=loss, rounds=3).items()]
    found += [("ic", n, w) for n, w in ranking.ic_weights(rows, NAMES, "fwd_1").items()]
    return spark.createDataFrame(found, "model string, name string, weight double")


@query(
    f"""SELECT date_, code, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY date_ ORDER BY round(score, 9) DESC, code) AS INTEGER) AS place FROM (SELECT date_, code, {' + '.join(f'coalesce({_part(n, "zscore_mean")}, 0) * {w}' for n, w in GROUP.items())} AS score FROM ({WIDE_SQL}))) WHERE place <= 4""",
    ("score",),
)
def ranking_selected(spark, sf_dir):
    return ranking.select(ranking.predict(wide(spark, sf_dir), GROUP), 4)


# -- store ------------------------------------------------------------------

SPEC = DatasetSpec("close", group="panel")


def stored_close(spark, sf_dir) -> Store:
    store = Store(spark, folder(spark))
    store.write(SPEC, long_factor(monthly(spark, sf_dir), "close"))
    return store


def shown_day(df: DataFrame) -> DataFrame:
    return df.withColumn("date_", F.to_date("date_"))


@query(f"SELECT date_, CAST(code AS VARCHAR) AS code, close AS value FROM ({MONTHLY_SQL}) WHERE date_ BETWEEN DATE '1994-03-01' AND DATE '1996-06-30' AND code IN (1, 2, 3) AND close >= 50000", ("value",))
def store_pruned_read(spark, sf_dir):
    return shown_day(stored_close(spark, sf_dir).read(SPEC, start="1994-03-01", end="1996-06-30", codes=["1", "2", "3"], low=50000.0, columns=["date_", "code", "value"]))


@query(f"SELECT date_, CAST(code AS VARCHAR) AS code, CASE WHEN date_ >= DATE '1997-01-01' THEN close * 2 ELSE close END AS value FROM ({MONTHLY_SQL})", ("value",))
def store_upsert(spark, sf_dir):
    store = stored_close(spark, sf_dir)
    late = monthly(spark, sf_dir).where("date_ >= '1997-01-01'").withColumn("close", F.col("close") * 2)
    store.upsert(SPEC, long_factor(late, "close"))
    return shown_day(store.read(SPEC).select("date_", "code", "value"))


@query(f"SELECT date_, CAST(code AS VARCHAR) AS code, close, volume FROM ({MONTHLY_SQL})", ("close", "volume"))
def store_many_factors(spark, sf_dir):
    store = stored_close(spark, sf_dir)
    other = DatasetSpec("volume", group="panel")
    store.write(other, long_factor(monthly(spark, sf_dir), "volume"))
    return shown_day(store.factors({"close": SPEC, "volume": other}, "full"))


@query(f"SELECT count(*) AS rows, min(date_)::VARCHAR AS start, max(date_)::VARCHAR AS \"end\", count(DISTINCT code) AS codes, count(DISTINCT date_trunc('month', date_)) AS files FROM ({MONTHLY_SQL})")
def store_manifest(spark, sf_dir):
    found = stored_close(spark, sf_dir).manifest(SPEC)
    return spark.createDataFrame([(found["rows"], found["start"][:10], found["end"][:10], found["codes"], found["files"])], "rows long, start string, end string, codes long, files long")


# -- streams ----------------------------------------------------------------


@query(ORACLE["hourly_bars"])
def stream_hourly_bars(spark, sf_dir):
    """The bars of :func:`hourly_bars` by a stream that reads what there is and ends."""
    from quantloom.plans.factors import shown

    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")  # a pattern, as a stream takes no single file
    ticks = events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("price"), F.lit(1).alias("size"), F.col("event_id").alias("seq"))
    out, where = bars(ticks, "1 hour", code="event_type"), folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/batch={number}")

    q = out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{where}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{where}/batch={q.lastProgress['batchId']}")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumns({c: shown(F.col(c)) for c in ("open", "high", "low", "close")})


@query(
    """WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS t, CAST(value AS DOUBLE) AS v FROM events), g AS (SELECT *, CAST(coalesce(t >= lag(t) OVER w + INTERVAL 6 HOUR, TRUE) AS INTEGER) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
              s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, min(t) AS start, max(t) + INTERVAL 6 HOUR AS "end", count(*) AS n, sum(v) AS total FROM s GROUP BY user_id, k""",
    ("total",),
)
def session_windows(spark, sf_dir):
    """Sessions that end after six quiet hours; the same plan serves a stream."""
    from quantloom.streaming.bars import sessions

    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("v"))
    out = sessions(rows, "6 hours", "user_id", F.count("*").alias("n"), F.sum("v").alias("total"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    """WITH e AS (SELECT event_type AS code, CAST(ts AS TIMESTAMP) AS ts, CAST(value AS DOUBLE) AS price FROM events), b AS (SELECT unnest(range(0, 4)) AS k)
       SELECT code, time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start, avg(price) AS mean, count(*) AS n FROM e, b GROUP BY ALL""",
    ("mean",),
)
def sliding_windows(spark, sf_dir):
    """Means over four hours, one starting every hour."""
    from quantloom.streaming.bars import sliding

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("price"))
    out = sliding(rows, "4 hours", "1 hour", "code", F.avg("price").alias("mean"), F.count("*").alias("n"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
