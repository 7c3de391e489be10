"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Native: DataFrame functions only. The law is ``key``: a record's key and the
list of shards decide its shard. Each shard draws a number from the record's
key; the record goes to the shard with the highest ``-weight / ln(u)``. A new
shard takes records only into itself; about ``w / total`` of them move.

Defined results: a null key counts as the text ``null``; a null text has size 1
and the checksum of an empty text, a very long one is counted whole; repeated rows each get a slot of
their own, in no stated order among themselves; an empty table gives an empty result. Columns of the
input that are not named here are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import stored

#: Parts of a shard within which slots are counted in one task.
SLOT_PARTS = 512


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key over ``len(weights)`` weighted shards."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def drawn(shard: int, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat_ws("\x1f", F.lit(str(shard)), text).cast("binary")), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard"))

    best = F.greatest(*(drawn(i, w) for i, w in enumerate(weights))) if len(weights) > 1 else drawn(0, weights[0])
    return (-best["shard"]).cast("int")


def place(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], *, key: str = "doc_id", text: str = "text", parts: int = SLOT_PARTS) -> DataFrame:
    """Shard, slot, and the shard with one more, of every row.

    The documents are read once, for a table of about 40 bytes a row in the shared folder. Slots
    are gapless in each shard: a shard is cut into ``parts`` by the rows' places in the input, so that
    no task counts a whole shard and many rows of one key or text spread like all others; only the
    ``shards x parts`` totals, whose number does not grow with the data, are summed up in one place.
    """
    from pyspark.sql import Window

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part"),
    )
    rows = stored(rows)
    totals = rows.groupBy("shard", "part").agg(F.count("*").alias("total"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_last(), "size", "text_crc32"))
    slots = rows.withColumn("nth", nth).join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))  # at most shards x parts rows
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).alias("slot"), "grown_shard")
