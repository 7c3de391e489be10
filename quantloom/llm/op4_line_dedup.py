"""Line dedup by pairwise alignment.

A document is compared with the first documents that hold its repeated lines and runs:
each line, and each shortest run of lines from or up to a line that has MIN_WORDS words,
proposes one pair, (document, its first holder). Any block that is long enough is
covered by such runs, so each part of it has a partner that holds this part whole,
whoever holds the single lines first. A line in thousands of documents makes thousands
of pairs and not millions, and no line is too frequent to count. A pair's lines are aligned by patience diff: lines that
occur once in both documents are anchors, the longest rising chain of them is kept,
and the gaps between are aligned likewise. Aligned lines that follow one another in both
documents are a block; blocks of at least MIN_WORDS words are deleted from the later
document. What lies between such blocks, where lines may stand twice and make no anchors,
is aligned exactly: by the blocks, in the same order in both, that hold most words. A line's
first holder keeps it, so nothing vanishes from the corpus. As an alignment is one to one, a
passage that stands once in the earlier document and twice in the later goes once.

Lines are compared without white space at their ends. Later means a larger doc_id; rows
without one come last, rows with equal ids go by the digest of their texts. Defined
results: a null text stays null and an empty one empty; rows that are equal in doc_id and text are the same
document, each kept as it is; an exact copy loses all lines and keeps its row; a very long text is
aligned whole; other columns are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import DARK, byte_set, mix, pieces, runs, span_hashes, stored, text_bytes, tidy, unused

#: Words in the smallest block that is deleted.
MIN_WORDS = 10
#: Lines that are looked up in a broadcast table, and first holders that are dealt over salts, at most; rows that make one of these, at least.
HOT_LINES, HOT_FIRSTS, HOT_ROWS, SALTS = 2000, 2000, 1000, 64

_LINE = ~byte_set((10, 10))


def lines_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and number of words of every line of every text, and per text the first line.

    The hash of a line without words is 0.
    """
    data, offs = text_bytes(column)
    full = np.diff(offs) > 0
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1][full], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offs[1:][full], breaks]), kind="stable")
    first = np.searchsorted(breaks, offs) + np.concatenate([[0], np.cumsum(full)])
    begins, stops, _ = runs(data, offs, DARK & _LINE)
    low, high = np.searchsorted(begins, starts), np.searchsorted(begins, ends)
    words = high - low
    some = words > 0
    hashes = np.zeros(len(starts), np.uint64)
    hashes[some] = span_hashes(data, begins[low[some]], stops[high[some] - 1]) | np.uint64(1)
    return hashes, words, first


def runs_of(hashes: np.ndarray, words: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shortest runs of two or more lines with enough words, from every line on and up to every line; per text the first.

    A line with enough words is a run of its own, and has its own hash.
    """
    some = np.flatnonzero(words > 0)  # all lines that count, each with the number of blank ones before it
    start = np.searchsorted(some, first)
    n = len(some)
    gaps = np.diff(some, prepend=-1)
    sums = np.concatenate([[0], np.cumsum(words[some], dtype=np.int64)])
    text = np.repeat(np.arange(len(first) - 1), np.diff(start))
    at = np.arange(n)
    ends = np.searchsorted(sums, sums[at] + min_words)
    begins = np.searchsorted(sums, sums[at + 1] - min_words, "right") - 1
    low, high = ends <= start[text + 1], begins >= start[text]
    spans = np.unique(np.concatenate([at[low] * (n + 1) + ends[low], begins[high] * (n + 1) + at[high] + 1]))
    a, b = spans // (n + 1), spans % (n + 1)
    a, b = a[b - a > 1], b[b - a > 1]
    out = mix((b - a).astype(np.uint64))
    for k in range(int((b - a).max()) if len(a) else 0):  # a run has at most min_words such lines
        live = np.flatnonzero(b - a > k)
        step = hashes[some[a[live] + k]] + mix(gaps[a[live] + k].astype(np.uint64) * np.uint64(k > 0))
        out[live] = mix((out[live] ^ step) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return out, np.searchsorted(a, start)


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: pairs of equal lines, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        many_a, many_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        at = {x: j for j, x in enumerate(b[blo:bhi], blo) if many_b[x] == 1 and many_a.get(x) == 1}
        anchors = _rising([(i, at[x]) for i, x in enumerate(a[alo:ahi], alo) if x in at])
        if not anchors:
            continue
        i, j = alo, blo
        for x, y in anchors:
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, ahi, j, bhi))
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs (sorted by the first) that rises in the second."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tops, j)
        before[k] = ends[n - 1] if n else -1
        if n == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[n], ends[n] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


Block = tuple[int, int, int]


def blocks_between(a: list[int], words: list[int], b: list[int], min_words: int) -> list[Block]:
    """Blocks (start in a, start in b, lines) of enough words, rising in both, that hold most words in all.

    Row by row over ``a``: ``best`` has the words in blocks before every place of ``b``, ``here`` those with
    a block that ends at this line. A block starts as a run that its last line gives enough words, and grows from there.
    """
    common = set(a) & set(b)
    most = total = 0
    for x, n in zip(a, words, strict=True):
        total = total + n if x in common else 0
        most = max(most, total)
    if most < min_words:
        return []
    at = {x: np.array([j for j, y in enumerate(b) if y == x]) for x in common}
    m, sums = len(b), [0]
    for n in words:
        sums.append(sums[-1] + n)
    best, node = np.zeros(m + 1, np.int64), np.full(m + 1, -1, np.int64)
    rows: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (best, node)}
    blank = np.full(m + 1, -1, np.int64)
    run, here, start, before = np.zeros(m + 1, np.int64), blank, blank, blank
    found: list[tuple[int, int, int, int]] = []  # end in a, end in b, start in a, the block before
    low = -1
    for i, x in enumerate(a):
        known = low + 1  # what starts before had enough words a line ago
        while sums[i + 1] - sums[low + 1] >= min_words:
            low += 1
        if x not in common:
            run, here = np.zeros(m + 1, np.int64), blank
        else:
            j = at[x]
            length = run[j] + 1
            score, begin, last = np.where(here[j] >= 0, here[j] + words[i], -1), start[j], before[j]
            for first in range(known, low + 1):
                n = i + 1 - first
                new = np.flatnonzero(length >= n)
                top, tops = rows[first]
                fresh = top[j[new] + 1 - n] + sums[i + 1] - sums[first]
                new, fresh = new[fresh > score[new]], fresh[fresh > score[new]]
                score[new], begin[new], last[new] = fresh, first, tops[j[new] + 1 - n]
            run = np.zeros(m + 1, np.int64)
            here, start, before = blank.copy(), blank.copy(), blank.copy()
            run[j + 1], here[j + 1], start[j + 1], before[j + 1] = length, score, begin, last
            if (score > best[j + 1]).any():
                over = np.maximum.accumulate(np.maximum(best, here))
                ends = np.flatnonzero((here > best) & (here == over) & (over > np.concatenate([[-1], over[:-1]])))
                source = np.zeros(m + 1, np.int64)
                source[ends] = len(found) + np.arange(len(ends))
                found.extend((i + 1, int(e), int(start[e]), int(before[e])) for e in ends)
                best, node = over, np.where(over > best, np.maximum.accumulate(source), node)
        for k in range(known, low + 1):
            del rows[k]
        rows[i + 1] = (best, node)
    out, k = [], int(node[m])
    while k >= 0:
        i, j, begin, k = found[k]
        out.append((begin, j - (i - begin), i - begin))
    return out[::-1]


def _grown(blocks: list[Block], a: list[int], b: list[int]) -> list[Block]:
    """Blocks with the equal lines next to them that no other block has."""
    out: list[Block] = []
    ends = [*blocks[1:], (len(a), len(b), 0)]
    alo = blo = 0
    for (i, j, n), (ahi, bhi, _) in zip(blocks, ends, strict=False):
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
            n += 1
        alo, blo = i + n, j + n
        out.append((i, j, n))
    return out


def repeated(later: list[int], words: list[int], earlier: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """Lines of the later document in aligned blocks of enough words."""
    blocks: list[Block] = []
    for i, j in aligned(later, earlier):
        x, y, n = blocks[-1] if blocks else (-1, -1, 0)
        if (x + n, y + n) == (i, j):
            blocks[-1] = (x, y, n + 1)
        else:
            blocks.append((i, j, 1))
    blocks = _grown([(i, j, n) for i, j, n in blocks if sum(words[i : i + n]) >= min_words], later, earlier)
    whole: list[Block] = []
    alo = blo = 0
    for i, j, n in [*blocks, (len(later), len(earlier), 0)]:
        whole += [(alo + x, blo + y, k) for x, y, k in blocks_between(later[alo:i], words[alo:i], earlier[blo:j], min_words)]
        if n:
            whole.append((i, j, n))
        alo, blo = i + n, j + n
    return [x for i, _, n in _grown(whole, later, earlier) for x in range(i, i + n)]


@tidy("op4_line_dedup")
def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            hashes, words, first = lines_of(piece.column("text"))
            marks, start = runs_of(hashes, words, first)
            offsets, starts = pa.array(first, pa.int32()), pa.array(start, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("h"),
                    pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64), pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(words, pa.int32())),
                    pa.ListArray.from_arrays(starts, pa.array(marks.view(np.int64), pa.int64())),
                ],
                ["doc_id", "h", "lines", "words", "runs"],
            )


@tidy("op4_line_dedup")
def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [repeated(x, w, y) for x, w, y in zip(*(batch.column(c).to_pylist() for c in ("lines", "words", "first_lines")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), batch.column("first_id"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "h", "first_id", "found"])


def _key():
    """Order of documents: smaller is earlier."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("h"))


def _digest():
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def _hot(counts: DataFrame, total: int, hot: int) -> DataFrame:
    """The rows whose ``n`` is more than a share of 1 / ``hot`` of the total, and more than a thousand: at most ``hot`` of them."""
    return counts.where(F.col("n") > max(HOT_ROWS, total // hot))


def _candidates(held: DataFrame) -> DataFrame:
    """(k, first): every document with the first holder of each of its repeated lines and runs.

    The few hottest lines, whose number has a bound, are looked up from a broadcast table and not shuffled.
    """
    shared = stored(held.groupBy("line").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n")).where("first <> last").select("line", "first", "n"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(_hot(shared, total, HOT_LINES).select("line", F.col("first").alias("hot_first")))
    marked = held.join(hot, "line", "left")
    cold = marked.where("hot_first is null").join(shared.select("line", "first"), "line").select("k", "first")
    pairs = marked.where("hot_first is not null").select("k", F.col("hot_first").alias("first")).unionByName(cold)
    return pairs.where("k <> first").groupBy("k", "first").agg(F.lit(1).alias("one")).drop("one")


def deletions(docs: DataFrame) -> DataFrame:
    """(doc_id, h, found, partners): lines to delete of documents that have some; h is the digest of the text.

    A first holder of many partners is dealt over SALTS copies of its lines, each with a part of the partners.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    listed = stored(rows.mapInArrow(_lines, "doc_id long, h binary, lines array<long>, words array<int>, runs array<long>"))
    held = listed.select(_key().alias("k"), F.explode(F.array_distinct(F.concat("lines", "runs"))).alias("line")).where("line <> 0")
    pairs = stored(_candidates(held))
    own = listed.groupBy("doc_id", "h").agg(F.first("lines").alias("lines"), F.first("words").alias("words")).withColumn("k", _key())
    hot = F.broadcast(_hot(pairs.groupBy("first").agg(F.count("*").alias("n")), pairs.count(), HOT_FIRSTS).select("first", F.lit(SALTS).alias("salts")))
    dealt = pairs.join(hot, "first", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("k"), F.col("salts"))).cast("int"))
    partner = own.select(F.col("k").alias("first"), F.col("lines").alias("first_lines"), F.col("doc_id").alias("first_id")).join(hot, "first", "left")
    partner = partner.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    full = dealt.drop("salts").join(own, "k").join(partner, ["first", "salt"])
    found = full.select("doc_id", "h", "first_id", "lines", "words", "first_lines").mapInArrow(_aligned, "doc_id long, h binary, first_id long, found array<int>")
    found = found.where(F.size("found") > 0)
    return found.groupBy("doc_id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"), F.array_sort(F.collect_set("first_id")).alias("partners"))  # at most one list per line of the document


def _with_found(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents with the lines to delete and the documents they stand in; the names of these two columns."""
    key, digest, found, partners, own = unused(docs, "key", "digest", "found", "partners", "own")
    some = deletions(docs).select(F.col("doc_id").alias(key), F.col("h").alias(digest), F.col("found").alias(found), F.col("partners").alias(partners))
    marked = docs.withColumn(own, _digest())
    out = marked.join(some, (F.col(own) == F.col(digest)) & F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left")
    return out.drop(own, digest, key), found, partners


def _left_over(found: str):
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(found))
    return F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their columns; later copies of aligned blocks are gone from the texts."""
    out, found, _ = _with_found(docs)
    left = _left_over(found)
    fresh = {"text": left}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        fresh["n_chars"] = F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length(left).cast(kind))
    return out.select(*(fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """Per row: lines, deleted lines, the documents they were found in, and the digest of what is left."""
    rows, found, partners = _with_found(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.col(partners), F.array().cast("array<bigint>")).alias("partners"),
        F.sha2(F.coalesce(_left_over(found), F.lit("")).cast("binary"), 256).alias("left_sha256"),
    )
