"""Near-duplicates by DartMinHash signatures, a banded join and exact checks.

Signature. Every element of a document's weighted set has a plane of weight by rank
into which hashed darts fall at a rate of one per unit area, the same in every
document. A document sees the darts below its element's weight and below a rank that
suffices for about ``t ln t`` darts in all; each dart hits one of ``t`` coordinates,
and the earliest dart on a coordinate is its value. Two documents agree on a
coordinate with the probability of their weighted Jaccard likeness. The work is
``t log t`` per document, plus one step per element. The plane is cut by weight into
regions [2**v - 1, 2**(v+1) - 1) with a Poisson process each. The elements are a document's
shingles and their weights the times that it has them.

Join. Coordinates make up bands of R; documents with an equal band share a bucket.
With 24 bands of 4, a pair of likeness 0.8 shares none with a probability of 4e-6.

Links. Texts that are equal are one class from the start. In every bucket the text that shares
buckets with most others is checked against all others of the bucket, by the exact weighted Jaccard likeness of their shingle
counts (the n-th time of a shingle is an element of its own): one pair per member, however large the bucket. Buckets that hold several components
then may hold links between others than that one. Their texts go through a join on the
rare ends of their shingle sets, which finds all pairs of the likeness and rules most
others out without making them; only pairs of different components are made and checked.

Shingles: five words (ASCII letters and digits in lower case, and all beyond ASCII); a text of fewer words
has one shingle of all. Defined results: null or empty texts, and texts without words, each are in a
class of their own text; a class is named by its smallest doc_id (null only if no member
has one); repeated rows are in one class; a very long text is worked on whole, at memory in proportion
to it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import LOWER, WORD, joined, mix, pieces, runs, shingles, span_hashes, stored, text_bytes, tidy, unused

WORDS, LIKENESS = 5, 0.8
#: Bands, and coordinates in a band.
BANDS, R = 24, 4
#: Expected darts beyond t ln t, per coordinate.
SPARE = 3.0
#: Rows up to which a table of digests and labels is broadcast (at most 60 bytes each); beyond it a join shuffles.
BROADCAST_ROWS = 300_000
#: Words of 64 bits in a set's bitmap.
MAP = 32


def signatures(elements: np.ndarray, ptr: np.ndarray, t: int = BANDS * R, weights: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """One row of t dart names per set ``elements[ptr[i]:ptr[i+1]]`` of hashes; a set without elements has zeros.

    Without weights every element weighs 1, and repeats of an element count once.
    """
    n = len(ptr) - 1
    sizes = np.diff(ptr)
    doc = np.repeat(np.arange(n), sizes)
    mass = sizes.astype(np.float64) if weights is None else np.bincount(doc, weights, n)
    out = np.zeros((n, t), np.uint64)
    todo = np.flatnonzero(mass > 0)
    limit = np.full(n, 0.0)
    limit[todo] = t * (np.log(t) + SPARE) / mass[todo]
    while len(todo):
        part = np.isin(doc, todo, assume_unique=False) if len(todo) < n else slice(None)
        own = elements[part], doc[part], None if weights is None else weights[part]
        where, rank, dart = _throw(own[0], own[1], limit, t, own[2], seed)
        order = np.argsort(-rank, kind="stable")  # the earliest dart of a coordinate is written last
        out.reshape(-1)[where[order]] = dart[order]
        hit = np.zeros(n * t, bool)
        hit[where] = True
        todo = todo[~hit.reshape(n, t)[todo].all(axis=1)]
        limit[todo] *= 2
    return out


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _throw(elements: np.ndarray, doc: np.ndarray, limit: np.ndarray, t: int, weights: np.ndarray | None, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts that documents see: flat coordinate (doc * t + coordinate), rank, name."""
    where, ranks, darts = [], [], []
    region = 0
    while True:
        floor, rate = float(2**region - 1), float(2**region)
        if weights is None:
            if region:
                break
            e, d, w = elements, doc, None
        else:
            high = weights > floor
            if not high.any():
                break
            e, d, w = elements[high], doc[high], weights[high]
        state = mix(e + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64) + np.uint64(region))
        rank, top = np.zeros(len(e)), limit[d]
        # the gap to the first dart decides for most elements of a long text; no logarithm is needed to see it
        least = np.exp(-top * rate)
        step = 0
        while len(state):
            step += 1
            state = mix(state + np.uint64(step))
            u = _uniform(state)
            if step == 1:
                keep = u > least
                state, d, rank, top, u = state[keep], d[keep], rank[keep], top[keep], u[keep]
                w = None if w is None else w[keep]
            rank = rank - np.log(u) / rate
            keep = rank <= top
            state, d, rank, top = state[keep], d[keep], rank[keep], top[keep]
            w = None if w is None else w[keep]
            if not len(state):
                break
            name = mix(state ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            seen = slice(None) if w is None else floor + _uniform(mix(name + np.uint64(1))) * rate < w
            where.append((d * t + (mix(name + np.uint64(2)) % np.uint64(t)).astype(np.int64))[seen])
            ranks.append(rank[seen])
            darts.append(name[seen])
        region += 1
    return joined(where, np.int64), joined(ranks, np.float64), joined(darts, np.uint64)


def bands(rows: np.ndarray, r: int = R) -> np.ndarray:
    """A hash per band; bands at different places differ."""
    n, t = rows.shape
    cut = rows.reshape(n, t // r, r)
    h = np.broadcast_to(np.arange(1, t // r + 1, dtype=np.uint64), (n, t // r)).copy()
    for i in range(r):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, i])
    return h


def word_shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    data, offs = text_bytes(column)
    starts, ends, first = runs(data, offs, WORD)
    return shingles(span_hashes(LOWER[data], starts, ends), first, words)


def counted(hashes: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each set, the times that each has, and per set the first."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), ptr
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((hashes, doc))
    h, doc = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(doc[at], np.arange(len(ptr)))


def numbered(elements: np.ndarray, times: np.ndarray) -> np.ndarray:
    """One element for every time of each; the first keeps its name."""
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    out = np.repeat(elements, times)
    again = nth > 0
    out[again] = mix(out[again] + mix(nth[again].astype(np.uint64)))
    return out


@tidy("op10_dartminhash")
def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            elements, times, ptr = counted(*word_shingles(piece.column("text")))
            rows = bands(signatures(elements, ptr, weights=times.astype(np.float64)))
            some = np.diff(ptr) > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(some, rows.shape[1], 0))])
            values = rows[some].reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("h"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))],
                ["doc_id", "h", "bands"],
            )


@tidy("op10_dartminhash")
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            hashes, first = word_shingles(piece.column("text"))
            elements, times, _ = counted(hashes, first)
            values = numbered(elements, times)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(piece.num_rows + 1) * MAP, pa.int32()), pa.array(bitmaps(values, first).reshape(-1).view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([piece.column("h"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64), pa.int64())), bits], ["h", "s", "bits"])


def bitmaps(elements: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """MAP words of 64 bits per set; each element sets one bit.

    A bit that one of two maps has alone stands for an element that this set has alone, so the number of such bits
    is never above the number of elements in which the sets differ.
    """
    out = np.zeros((len(ptr) - 1, MAP * 64), bool)
    out[np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), (elements % np.uint64(MAP * 64)).astype(np.int64)] = True
    return np.packbits(out, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _texts(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(body.cast("binary"))).alias("h"), body.alias("text"))


def near_duplicates(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """Per row: doc_id, class_id, class_texts (different texts in the class), h (digest of the text), c (smallest h of the class)."""
    texts = _texts(docs)
    marked = stored(texts.mapInArrow(_banded, "doc_id long, h binary, bands array<long>"))
    classes = marked.groupBy("h").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"))
    placed = classes.select("h", "first", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
    members = stored(placed.join(shared, "key", "left_semi").select("key", "h", "first"))
    component = _components(docs, members, likeness)
    label = component.groupBy("c").agg(F.count("*").alias("class_texts"))
    named = marked.select("doc_id", "h").join(component.join(label, "c"), "h", "left").select("doc_id", "h", F.coalesce("c", "h").alias("c"), F.coalesce("class_texts", F.lit(1)).alias("class_texts"))
    ids = named.groupBy("c").agg(F.min("doc_id").alias("class_id"))
    return named.join(ids, "c").select("doc_id", "class_id", "class_texts", "h", "c")


def _small(df: DataFrame) -> DataFrame:
    """A stored table for a join: broadcast only if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _components(docs: DataFrame, members: DataFrame, likeness: float) -> DataFrame:
    """(h, c): the component of every text that shares a bucket; c is the smallest h of the component."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    firsts = stored(members.join(sizes, "key").groupBy("h").agg(F.min("first").alias("first"), F.sum("size").alias("company")))
    sets = _sets_of(docs, firsts.select("h", "first"))
    component = stored(sets.select("h", F.col("h").alias("c"), F.size("s").alias("n")))
    # one pair per bucket and member: with the text that meets most others, which of edited copies is one with few edits
    hubs = members.select("key", "h").join(_small(firsts.select("h", "company")), "h").groupBy("key").agg(F.max(F.struct("company", "h")).alias("hub")).select("key", F.col("hub.h").alias("hub"))
    stars = members.join(hubs, "key").where(F.col("h") != F.col("hub")).select(F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b")).distinct()
    component = _joined_up(component, stored(_alike(stars, sets, likeness)))
    # buckets of several components may hold links yet
    labels = members.join(_small(component), "h").select("key", "h", "c")
    open_keys = labels.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    still = stored(members.join(open_keys, "key", "left_semi").select("h").distinct())
    rest = _prefix_pairs(sets.join(_small(still), "h", "left_semi").join(_small(component), "h"), likeness)
    return _joined_up(component, stored(_alike(rest, sets, likeness))).select("h", "c")


def _prefix_pairs(rows: DataFrame, likeness: float) -> DataFrame:
    """Pairs of rows (h, s, c, n) of different components that may reach the likeness; no such pair is lost.

    Two sets of this likeness have a common element among the first few of both, in any
    fixed order. Rare elements come first here: what is edited in a copy is its own, so
    the first elements of a copy that differs too much meet nobody. Elements that one
    set alone has are counted, and not joined. A first common element must leave enough elements after it,
    and the sets' bitmaps must not differ in more bits than the sets may differ in elements.
    """
    elements = rows.select("h", F.explode("s").alias("e"))
    common = elements.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    ordered = elements.join(common, "e").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("list"))  # of one text each
    own = F.col("n") - F.size("list")
    first = (F.col("n") - F.ceil(F.col("n") * likeness - 1e-6) + 1).cast("int")
    some = ordered.join(rows.select("h", "c", "n", "bits"), "h").where(first > own)
    probes = some.select("h", "c", "n", "bits", own.alias("own"), F.posexplode(F.slice("list", F.lit(1), first - own)).alias("i", "x")).select("h", "c", "n", "bits", F.col("x.e").alias("e"), (F.col("n") - F.col("own") - F.col("i")).alias("left"))
    probes = stored(probes)
    a = probes.select(F.col("h").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("bits").alias("ba"), "e")
    b = probes.select(F.col("h").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("bits").alias("bb"), "e")
    enough = F.least("la", "lb") >= (F.col("na") + F.col("nb")) * (likeness / (1 + likeness)) - 1e-6
    apart = sum((F.bit_count(F.get("ba", F.lit(i)).bitwiseXOR(F.get("bb", F.lit(i)))) for i in range(MAP)), F.lit(0))
    enough &= apart <= (F.col("na") + F.col("nb")) * ((1 - likeness) / (1 + likeness)) + 1e-6
    alike = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * likeness - 1e-6) & enough
    return a.join(b, "e").where(alike).select("a", "b").distinct()


def _sets_of(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h, s, bits): the shingle sets of texts and their bitmaps, each taken from the row with the smallest doc_id."""
    own = F.struct(F.col("doc_id").isNull(), "doc_id")
    wanted = _small(firsts.select("h", F.struct(F.col("first").isNull(), F.col("first").alias("doc_id")).alias("at")))
    some = _texts(docs).withColumn("at", own).join(wanted, ["h", "at"], "left_semi").select("h", "text")
    return stored(some.mapInArrow(_sets, "h binary, s array<long>, bits array<long>").groupBy("h").agg(F.first("s").alias("s"), F.first("bits").alias("bits")))


def _alike(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """Pairs whose shingle sets have at least this Jaccard likeness."""
    left, right = sets.select(F.col("h").alias("a"), F.col("s").alias("sa")), sets.select(F.col("h").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= likeness * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _joined_up(component: DataFrame, links: DataFrame) -> DataFrame:
    """Components after adding links.

    The smallest label spreads over the links between components until none
    changes; a label also takes its own label's label, so that paths halve in every round.
    """
    names = _small(component)
    a, b = names.select(F.col("h").alias("a"), F.col("c").alias("ca")), names.select(F.col("h").alias("b"), F.col("c").alias("cb"))
    some = links.join(a, "a").join(b, "b").where("ca <> cb").select("ca", "cb")
    edges = stored(some.unionByName(some.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct())
    if edges.isEmpty():
        return component
    label = stored(edges.groupBy(F.col("ca").alias("v")).agg(F.min(F.least("ca", "cb")).alias("low")))
    while True:
        known = _small(label)
        heard = edges.join(known.select(F.col("v").alias("cb"), "low"), "cb").groupBy(F.col("ca").alias("v")).agg(F.min("low").alias("heard"))
        new = heard.join(known, "v").select("v", F.least("low", "heard").alias("low"), (F.col("heard") < F.col("low")).alias("changed"))
        up = known.select(F.col("v").alias("low"), F.col("low").alias("lower"))
        new = stored(new.join(up, "low", "left").select("v", F.least("low", F.coalesce("lower", "low")).alias("low"), "changed"))
        label = new.select("v", "low")
        if new.where("changed").isEmpty():
            break
    out = component.join(_small(label).select(F.col("v").alias("c"), "low"), "c", "left")
    return stored(out.select("h", F.coalesce("low", "c").alias("c"), "n"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of documents per class: that of the smallest doc_id."""
    key, digest, own = unused(docs, "key", "digest", "own")
    best = near_duplicates(docs).groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("best"))
    chosen = best.select(F.col("best.doc_id").alias(key), F.col("best.h").alias(digest))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.withColumn(own, F.unhex(F.md5(body.cast("binary"))))
    kept = marked.join(chosen, (F.col(own) == F.col(digest)) & F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own)
