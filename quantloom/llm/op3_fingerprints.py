"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct hashes of a document's shingles. Sketches
of parts merge by keeping the k smallest of their union, and estimate resemblance,
containment and the number of distinct shingles. With fewer than k hashes a sketch
holds all, and its estimates are exact.

Words are runs of bytes that aren't ASCII white space, shingles five words; a text
of fewer words, but not none, has one shingle of all. Defined results: a null or
empty text has the empty sketch; two empty sketches have likeness 1, an empty and a
full one 0; equal texts have equal fingerprints; repeated rows stay rows of their
own; the only row of a table is its own next; an empty table gives an empty result;
rows without a doc_id come last; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import CHUNK_BYTES, DARK, runs, shingles, span_hashes, text_bytes

#: Hashes in a sketch: a standard error of at most 0.5 / sqrt(k) for a likeness.
K = 256
#: Words in a shingle.
WORDS = 5
#: Rows that one range of document ids should hold.
RANGE_ROWS = 4000


def sketches(texts: list[str | None] | pa.Array, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The sorted k smallest distinct shingle hashes of each text."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    data, offs = text_bytes(column)
    starts, ends, first = runs(data, offs, DARK)
    hashes, ptr = shingles(span_hashes(data, starts, ends), first, words)
    out = []
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        h, part = hashes[a:b], 2 * k
        while part < len(h):  # the smallest few suffice unless many repeat
            low = np.unique(np.partition(h, part)[:part])
            if len(low) >= k:
                break
            part *= 4
        else:
            low = np.unique(h)
        out.append(low[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the shingle sets."""
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k)
    shared = np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True)
    return len(shared) / len(both)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1.0) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of a's shingles that b has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def pack(a: np.ndarray) -> str:
    """A sketch as text: hashes of 16 hex digits end to end."""
    return a.astype(">u8").tobytes().hex()


def unpack(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """One packed sketch per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack(x) for x in sketches(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def merged(prints: DataFrame, group: str, *, column: str = "fingerprint", k: int = K) -> DataFrame:
    """Sketches of groups of parts: the k smallest distinct hashes of each group.

    A sketch is unpacked to at most k rows; those of a group are dealt over 64
    salts first, each of which keeps k, so that a hot group is no hot task.
    """
    width = 16
    rows = prints.select(F.col(group), F.explode(F.expr(f"transform(sequence(0, greatest(length({column}), {width}) div {width} - 1), i -> substring({column}, i * {width} + 1, {width}))")).alias("h"))
    rows = rows.where("h <> ''").groupBy(group, "h").agg(F.count("*").alias("n"))

    def lowest(df: DataFrame, *by: str) -> DataFrame:
        from pyspark.sql import Window

        return df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= k).drop("r")

    salted = lowest(rows.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(64))), group, "salt")
    return lowest(salted, group).groupBy(group).agg(F.array_join(F.sort_array(F.collect_list("h")), "").alias(column))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranges(ids: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of the ranges of ``ord``; heads of the ranges that have rows, and the range each head follows.

    Decided on ids alone: their quantiles, then the highest id of each range. There
    is one number per RANGE_ROWS rows, 200,000 at most.
    """
    parts = max(1, min(200_000, ids.count() // RANGE_ROWS))
    cuts = ids.stat.approxQuantile("ord", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    bounds = np.unique(np.array(cuts, np.float64)).astype(np.int64)
    found = ids.groupBy(_placer(bounds)("ord").alias("range")).agg(F.max("ord").alias("head")).orderBy(F.desc("head")).collect()
    heads = np.array([r["head"] for r in found], np.int64)
    follows = np.array([found[i - 1]["range"] for i in range(len(found))], np.int32)
    return bounds, heads[::-1], follows[::-1]


def _placer(bounds: np.ndarray):
    @F.pandas_udf("int")
    def place(order: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, order.to_numpy(), "right").astype("int32"))

    return place


def compare(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose end comes from the next lower id.

    Ranges of ids are dealt out by one shuffle of the texts; the first row of each
    range goes to the range above it too, where it is the next of the last row.
    Rows of equal ids are ordered by text.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bounds, heads, follows = _ranges(rows.select("ord"))

    @F.pandas_udf("int")
    def above(order: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(heads, order.to_numpy()), max(0, len(heads) - 1))
        return pd.Series(np.where(heads[at] == order.to_numpy(), follows[at], -1).astype("int32"))

    own, guest = F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.col("above").alias("range"), F.lit(True).alias("guest"))
    dealt = (
        rows.withColumn("range", _placer(bounds)("ord"))
        .withColumn("above", above("ord"))
        .withColumn("to", F.explode(F.when(F.col("above") >= 0, F.array(own, guest)).otherwise(F.array(own))))
        .select(F.col("to.range").alias("range"), F.col("to.guest").alias("guest"), "ord", "doc_id", "text")
        .repartition("range")
        .sortWithinPartitions("range", "guest", F.desc("ord"), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            held, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text")), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= CHUNK_BYTES // 2:
                    yield _pairs(last + held, k)
                    last, held, size = held[-1:], [], 0
            if held:
                yield _pairs(last + held, k)
                last = held[-1:]

    return dealt.select("range", "guest", "doc_id", "text").mapInArrow(run, SCHEMA)


def _pairs(rows: list[tuple], k: int) -> pa.RecordBatch:
    """Results of all rows but the last whose next row is of the same range."""
    pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
    texts = [r[3] for r in rows]
    edited = []
    for i in pairs:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    plain, changed = sketches(pa.array(texts, pa.large_string()), k), sketches(pa.array(edited, pa.large_string()), k)
    columns = [
        pa.array([rows[i][2] for i in pairs], pa.int64()),
        pa.array([len(texts[i]) for i in pairs], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array([pack(plain[i]) for i in pairs], pa.string()),
        pa.array([pack(e) for e in changed], pa.string()),
        pa.array([resemblance(plain[i], e, k) for i, e in zip(pairs, changed, strict=True)], pa.float64()),
        pa.array([resemblance(plain[i], plain[i + 1], k) for i in pairs], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])
