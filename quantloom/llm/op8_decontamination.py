"""Benchmark decontamination with a positional inverted index stored in segments.

The index is partitioned by document: each segment holds some consecutive
documents and, per term, the sorted positions of its postings. A phrase is found by
taking the postings of its rarest term, moving them back by the term's offset, and
intersecting them with the postings of the next rarest terms, each moved likewise.
Proximity asks for terms in any order within a span. Segments are written to the
shared folder; a search reads them and needs no shuffle, as all that is known of a
document is in one segment.

The index holds the postings of all words of all documents, so one index answers any benchmark
and any phrase; a caller may give a vocabulary to index less. Terms are keyed 64-bit hashes; whole-word
hashes that clash would have to clash for every word of a window at once. The benchmark is searched
for in blocks of BLOCK_BYTES of its text: no more of it is held by the driver or sent to a worker at a time.

Words are runs of ASCII letters and digits and of everything beyond ASCII, in ASCII
lower case. Defined results: a null or empty text, or one without words, is never
hit and a benchmark item without words has no window; repeated documents are rows of
their own; repeated items count by their distinct item_id; an item without item_id
is left out; a very long document is a segment of its own; empty tables give no documents, or documents
without hits; other columns, whatever their names, are not read (``clean`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import LOWER, WORD, pieces, runs, span_hashes, stored, text_bytes, tidy, unused

#: Words in a window.
WINDOW = 13
#: A document is contaminated if one in so many of its words is hit.
SHARE = 20
#: Text bytes of the benchmark that are searched for at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 1 << 20
#: Text bytes of a segment of the index (or one document).
SEGMENT_BYTES = 4 << 20

SEGMENT = "rows array<long>, doc_ids array<long>, doc_starts array<int>, terms array<long>, term_starts array<int>, postings binary"


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts end to end, and per text the first."""
    data, offs = text_bytes(column)
    starts, ends, first = runs(data, offs, WORD)
    return span_hashes(LOWER[data], starts, ends), first


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: np.ndarray | None = None) -> DataFrame:
    """Segments of the index; with ``vocabulary``, a sorted array of term hashes, of those terms only."""

    @tidy("op8_decontamination")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", SEGMENT_BYTES):
                terms, first = words(piece.column("text"))
                if vocabulary is None:
                    places = np.arange(len(terms))
                else:
                    at = np.searchsorted(vocabulary, terms)
                    places = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == terms) if len(vocabulary) else np.zeros(0, np.int64)
                chosen = terms[places]
                order = np.argsort(chosen, kind="stable")
                names, begins = np.unique(chosen[order], return_index=True)
                row = [
                    pa.array([piece.column("row").to_pylist()], pa.list_(pa.int64())),
                    pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([first.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([names.view(np.int64)], pa.list_(pa.int64())),
                    pa.array([np.append(begins, len(order)).astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([places[order].astype("<i4").tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(row, ["rows", "doc_ids", "doc_starts", "terms", "term_starts", "postings"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SEGMENT)


class Segment:
    """Postings of one segment; positions count words from the segment's start."""

    def __init__(self, row: dict):
        self.rows, self.doc_ids = row["rows"], row["doc_ids"]
        self.first = np.array(row["doc_starts"], np.int64)
        self.terms = np.array(row["terms"], np.int64).view(np.uint64)
        self.ptr = np.array(row["term_starts"], np.int64)
        self.places = np.frombuffer(row["postings"], "<i4")

    def slots(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in the segment, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def list_of(self, slot: int) -> np.ndarray:
        return self.places[self.ptr[slot] : self.ptr[slot + 1]]

    def phrase(self, slots: np.ndarray) -> np.ndarray:
        """Positions at which the terms stand one after another in one document."""
        if (slots < 0).any():
            return np.zeros(0, np.int64)
        sizes = self.ptr[slots + 1] - self.ptr[slots]
        found: np.ndarray | None = None
        for k in np.argsort(sizes, kind="stable").tolist():
            moved = self.list_of(slots[k]) - k
            if found is None:
                found = moved
            elif len(moved) > 8 * len(found):
                at = np.minimum(np.searchsorted(moved, found), len(moved) - 1)
                found = found[moved[at] == found]
            else:
                found = np.intersect1d(found, moved, assume_unique=True)
            if not len(found):
                break
        found = found[found >= 0].astype(np.int64)
        doc = np.searchsorted(self.first, found, "right") - 1
        return found[found + len(slots) <= self.first[np.minimum(doc + 1, len(self.first) - 1)]]

    def near(self, slots: np.ndarray, span: int) -> np.ndarray:
        """Postings of the rarest term with all other terms in one document within ``span`` words of it."""
        if (slots < 0).any() or not len(slots):
            return np.zeros(0, np.int64)
        sizes = self.ptr[slots + 1] - self.ptr[slots]
        order = np.argsort(sizes, kind="stable").tolist()
        found = self.list_of(slots[order[0]]).astype(np.int64)
        doc = np.searchsorted(self.first, found, "right") - 1
        for k in order[1:]:
            other = self.list_of(slots[k])
            low = np.maximum(found - span, self.first[doc])
            high = np.minimum(found + span, self.first[doc + 1] - 1)
            keep = np.searchsorted(other, low, "left") < np.searchsorted(other, high, "right")
            found, doc = found[keep], doc[keep]
        return found


class Windows:
    """Distinct windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = WINDOW):
        items = [(i, t) for i, t in items if i is not None]
        terms, first = words(pa.array([t for _, t in items], pa.large_string()))
        at: dict[bytes, int] = {}
        self.rows: list[np.ndarray] = []
        self.items: list[set[int]] = []
        for k, (item, _) in enumerate(items):
            own = terms[first[k] : first[k + 1]]
            for j in range(max(1, len(own) - size + 1) if len(own) else 0):
                row = own[j : j + size]
                n = at.setdefault(row.tobytes(), len(at))
                if n == len(self.rows):
                    self.rows.append(row)
                    self.items.append(set())
                self.items[n].add(item)
        self.vocabulary = np.unique(np.concatenate(self.rows)) if self.rows else np.zeros(0, np.uint64)
        width = max(map(len, self.rows), default=1)
        #: Places in the vocabulary, filled up with the first place of the row.
        self.places = np.array([np.searchsorted(self.vocabulary, np.pad(r, (0, width - len(r)), mode="edge")) for r in self.rows], np.int64).reshape(len(self.rows), width)

    def search(self, segment: Segment) -> Iterator[tuple[int, np.ndarray]]:
        """Windows with occurrences, and their positions."""
        if not self.rows:
            return
        slots = segment.slots(self.vocabulary)[self.places]
        for w in np.flatnonzero((slots >= 0).all(axis=1)).tolist():
            hits = segment.phrase(slots[w, : len(self.rows[w])])
            if len(hits):
                yield w, hits


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_starts array<int>, hit_ends array<int>"
HITS = "row long, doc_id long, n_words long, items array<long>, hit_starts array<int>, hit_ends array<int>"


def search_segment(segment: Segment, block: Windows) -> pa.RecordBatch:
    """Per document the items with occurrences, and the spans of hit words counted from the document's start."""
    total, first = int(segment.first[-1]), segment.first
    change = np.zeros(total + 1, np.int32)
    found: dict[int, set[int]] = {}
    for w, hits in block.search(segment):
        np.add.at(change, hits, 1)
        np.add.at(change, hits + len(block.rows[w]), -1)
        for doc in np.unique(np.searchsorted(first, hits, "right") - 1).tolist():
            found.setdefault(doc, set()).update(block.items[w])
    hit = np.cumsum(change[:-1]) > 0
    starts, ends = [], []
    for doc in range(len(segment.doc_ids)):
        edge = np.diff(np.concatenate([[0], hit[first[doc] : first[doc + 1]].astype(np.int8), [0]])) if doc in found else np.zeros(0, np.int8)
        starts.append(np.flatnonzero(edge == 1).tolist())
        ends.append(np.flatnonzero(edge == -1).tolist())
    columns = [
        pa.array(segment.rows, pa.int64()),
        pa.array(segment.doc_ids, pa.int64()),
        pa.array(np.diff(first), pa.int64()),
        pa.array([sorted(found.get(d, ())) for d in range(len(segment.doc_ids))], pa.list_(pa.int64())),
        pa.array(starts, pa.list_(pa.int32())),
        pa.array(ends, pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in HITS.split(", ")])


def _search(index: DataFrame, block: Windows) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(block)  # windows of at most BLOCK_BYTES of text

    @tidy("op8_decontamination")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield search_segment(Segment({c: batch.column(c)[i].as_py() if c in ("postings", "rows", "doc_ids") else batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in batch.schema.names}), shared.value)

    return index.mapInArrow(run, HITS)


@tidy("op8_decontamination")
def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of documents from the lists of spans and items of all blocks."""
    for batch in batches:
        out = []
        for doc_id, n, items, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "items", "hit_starts", "hit_ends")), strict=True):
            spans: list[list[int]] = []
            for a, b in sorted((a, b) for x, y in zip(starts, ends, strict=True) for a, b in zip(x, y, strict=True)):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            names = sorted({str(i) for one in items for i in one})
            n_hit = sum(b - a for a, b in spans)
            out.append((doc_id, n, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and SHARE * n_hit >= n, [a for a, _ in spans], [b for _, b in spans]))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in RESULT.split(", ")])


def blocks_of(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", size: int = WINDOW) -> Iterator[Windows]:
    """The benchmark's windows in blocks, one at a time; one block without windows if it is empty."""
    held, length, some = [], 0, False
    for row in benchmark.select(item, text).where(F.col(item).isNotNull()).toLocalIterator():
        held.append((row[0], row[1]))
        length += len((row[1] or "").encode()) + 16
        if length >= BLOCK_BYTES:
            yield Windows(held, size)
            held, length, some = [], 0, True
    if held or not some:
        yield Windows(held, size)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, index: DataFrame | None = None) -> DataFrame:
    """Per document the words hit by windows of the benchmark; builds and stores the index unless one is given."""
    if index is None:
        index = stored(build_index(docs))
    blocks = blocks_of(benchmark, size=window)
    block, after = next(blocks), next(blocks, None)
    hits = _search(index, block)
    lists = ("items", "hit_starts", "hit_ends")
    if after is None:
        return hits.select("doc_id", "n_words", *(F.array(c).alias(c) for c in lists)).mapInArrow(_totals, RESULT)
    hits = stored(hits)  # all documents once; of further blocks only documents with hits
    while after is not None:
        hits = hits.unionByName(stored(_search(index, after).where(F.size("items") > 0)))
        after = next(blocks, None)
    whole = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.collect_list(c).alias(c) for c in lists))  # at most one list per block
    return whole.drop("row").mapInArrow(_totals, RESULT)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that aren't contaminated, with their columns.

    Rows are told apart by a 64-bit hash of text and id, as ids may repeat.
    """
    own, bad = unused(docs, "own", "bad")
    row = F.xxhash64("text", "doc_id")
    found = decontaminate(docs.select(row.alias("doc_id"), "text"), benchmark).where("contaminated")
    found = found.select(F.col("doc_id").alias(bad)).distinct()
    return docs.withColumn(own, row).join(found, F.col(own) == F.col(bad), "left_anti").drop(own)


def find_phrases(index: DataFrame, phrases: list[str]) -> DataFrame:
    """Exact occurrences of phrases: doc_id, phrase, and the number of the first word in the document."""
    return _find(index, phrases, None)


def find_near(index: DataFrame, phrases: list[str], span: int) -> DataFrame:
    """Documents with all terms of a phrase in any order within ``span`` words of its rarest term, and that term's place."""
    return _find(index, phrases, span)


def _find(index: DataFrame, phrases: list[str], span: int | None) -> DataFrame:
    terms, first = words(pa.array(phrases, pa.large_string()))
    lists = [terms[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]

    @tidy("op8_decontamination")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment, out = Segment(row), []
                for p, own in enumerate(lists):
                    if len(own):
                        slots = segment.slots(own)
                        for at in (segment.phrase(slots) if span is None else segment.near(slots, span)).tolist():
                            doc = int(np.searchsorted(segment.first, at, "right")) - 1
                            out.append((segment.doc_ids[doc], phrases[p], at - int(segment.first[doc])))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int32())], ["doc_id", "phrase", "at"])

    return index.mapInArrow(run, "doc_id long, phrase string, at int")
