"""Helpers shared by the corpus operators: tables, shared folder, vectorised words."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step works on; bounds the size of its arrays.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors of a cluster need a folder that all of them share")
        root = "file://" + tempfile.mkdtemp(prefix="quantloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/quantloom/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that all executors share."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application stored; for when no result of it is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What operators keep in a Python worker from task to task, by operator: functions that forget it.
_KEPT: dict[str, Callable[[], None]] = {}


def kept_by(name: str, forget: Callable[[], None]) -> None:
    _KEPT[name] = forget


def release() -> None:
    """Give unused memory of this worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: it frees in its own way


def begin(name: str) -> None:
    """An operator starts in this worker: what others keep goes. Workers serve one stage after the other."""
    for other, forget in _KEPT.items():
        if other != name:
            forget()


def tidy(name: str):
    """A function over batches that starts without what other operators keep, and leaves no unused memory behind."""

    def wrap(run):
        @functools.wraps(run)
        def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin(name)
            try:
                yield from run(batches)
            finally:
                release()

        return tidied

    return wrap


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array end to end, and the offsets of its texts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have at most ``limit`` bytes, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


_ODD = 0x9E3779B97F4A7C15
#: Key of the hashes of spans, and the bytes up to which they are made of 8-byte lanes in numpy.
_KEY, _LANES = 0x27D4EB2F165667C5, 64


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (fixed multipliers of a public mixer)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keyed 64-bit hash of each span of bytes, the same wherever the span stands.

    Short spans are mixed lane by lane of 8 bytes, all at once; long ones go through xxhash.
    """
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) + np.uint64(_KEY))
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= _LANES))
    at = 0
    while len(live):
        lane = lanes[starts[live] + at]
        short = np.maximum(8 - (size[live] - at), 0).astype(np.uint64) * np.uint64(8)
        lane = (lane << short) >> short
        out[live] = mix((out[live] ^ lane) * np.uint64(_ODD) + np.uint64(at + 1))
        at += 8
        live = live[size[live] > at]
    long = np.flatnonzero(size > _LANES)
    if len(long):
        raw = memoryview(data)
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b], _KEY) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def runs(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``member[byte]``, not across texts: starts, ends, and per text the first run."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = member[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = offs[:-1][offs[1:] > offs[:-1]]
    first[full] = inside[full]
    tails = offs[1:][offs[1:] > offs[:-1]] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: ASCII lower case for bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and everything beyond ASCII.
WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: All but ASCII white space.
DARK = ~byte_set((9, 13), (28, 32))


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one text, and per text the first.

    A text of fewer words, but not none, has one shingle of all of them.
    """
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ptr = np.zeros(len(first), np.int64)
    np.cumsum(n, out=ptr[1:])
    at = np.repeat(first[:-1] - ptr[:-1], n) + np.arange(ptr[-1])
    left = np.repeat(first[1:], n) - at
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for i in range(size):
        step = padded[at + i]
        out = mix(out * np.uint64(_ODD) + np.uint64(i + 1) + step) if i == 0 else np.where(left > i, mix(out * np.uint64(_ODD) + np.uint64(i + 1) + step), out)
    return out, ptr


def joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def spread(ptr: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ranges ``ptr[i]:ptr[i+1]`` for each i of ``which``, end to end, and their bounds."""
    n = ptr[which + 1] - ptr[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    return np.repeat(ptr[which] - out[:-1], n) + np.arange(out[-1]), out
