"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of 16 bytes, one starting at every eighth
byte, up to its end. Each byte has a learned embedding; learned filters look at a
chunk's embeddings; the largest answer of each filter over all chunks of the whole text goes into
one logistic unit. The network is trained on a bounded sample of labelled rows: the texts of at most
SAMPLE ids of each label, taken in the order of a hash of doc_id until SAMPLE_BYTES are read. A text is learned
from whole, whatever its length: only the chunks that win a filter have a gradient. Only the texts are inputs.

Defined results: a null or empty text is one chunk of padding, and scored as such;
repeated rows get equal scores; rows labelled both ways count by their mean label,
null labels are left out; without rows of both labels every score is the share
of good rows (0.5 without any); very long texts are scored whole, in bounded memory; an empty table
gives an empty result; other columns, whatever their names, are kept by ``accepted`` and not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import begin, release, text_bytes

#: Bytes between chunk starts; a chunk is two steps long.
STEP = 8
EMBEDDING, FILTERS = 8, 32
#: Labelled rows of each label, and text bytes in all, that the network is trained on.
SAMPLE, SAMPLE_BYTES = 1500, 32 << 20
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.01, 7
#: Chunks that are worked on at once.
CHUNKS = 1 << 16
GOOD = 0.7


class Network:
    """Parameters, forward pass and one training step."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32),
            "filter": rng.normal(0, (2 * STEP * EMBEDDING) ** -0.5, (2 * STEP * EMBEDDING, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "weight": rng.normal(0, 0.3, FILTERS).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }

    @staticmethod
    def blocks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of STEP byte codes; each text has its own, and one of padding (code 256) after them."""
        n = np.maximum(1, -(-np.diff(offs) // STEP)) + 1
        ptr = np.concatenate([[0], np.cumsum(n)])
        out = np.full((int(ptr[-1]), STEP), 256, np.int16)
        flat = out.reshape(-1)
        for a, b, to in zip(offs[:-1].tolist(), offs[1:].tolist(), (ptr[:-1] * STEP).tolist(), strict=True):
            flat[to : to + b - a] = data[a:b]
        return out, ptr

    def answers(self, blocks: np.ndarray) -> np.ndarray:
        """Filter answers of the chunks that start at each block but the last."""
        x = self.p["embed"][blocks].reshape(len(blocks), -1)
        half = STEP * EMBEDDING
        out = x[:-1] @ self.p["filter"][:half]
        out += x[1:] @ self.p["filter"][half:]
        out += self.p["bias"]
        return np.maximum(out, 0, out=out)

    def pooled(self, blocks: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """The largest of each filter's answers over each text's chunks."""
        top = np.zeros((len(ptr) - 1, FILTERS), np.float32)
        for at in range(0, len(blocks) - 1, CHUNKS):
            part = self.answers(blocks[at : at + CHUNKS + 1])
            first = np.searchsorted(ptr, at, "right") - 1
            last = np.searchsorted(ptr, at + len(part), "left")
            begins = np.maximum(ptr[first:last], at) - at
            ends = np.minimum(ptr[first + 1 : last + 1] - 1, at + len(part)) - at  # a text's padding starts no chunk
            keep = ends > begins
            texts, begins, ends = np.arange(first, last)[keep], begins[keep], ends[keep]
            if not len(texts):
                continue
            edges = np.stack([begins, ends], 1).reshape(-1)
            top[texts] = np.maximum(top[texts], np.maximum.reduceat(part, edges if ends[-1] < len(part) else edges[:-1], axis=0)[::2])
        return top

    def best(self, blocks: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :func:`pooled`, and the first block of the chunk that each answer is from."""
        top = np.full((len(ptr) - 1, FILTERS), -1, np.float32)
        place = np.zeros((len(ptr) - 1, FILTERS), np.int64)
        for i in range(len(ptr) - 1):
            for at in range(int(ptr[i]), int(ptr[i + 1]) - 1, CHUNKS):
                part = self.answers(blocks[at : min(at + CHUNKS + 1, int(ptr[i + 1]))])
                where = part.argmax(axis=0)
                most = part[where, np.arange(FILTERS)]
                more = most > top[i]
                top[i][more], place[i][more] = most[more], at + where[more]
        return top, place

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = (self.pooled(*self.blocks(data, offs)).astype(np.float64) * self.p["weight"]).sum(axis=1) + float(self.p["shift"][0])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, data: np.ndarray, offs: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the logistic loss of a few texts; they are the winning chunks' alone."""
        blocks, ptr = self.blocks(data, offs)
        p = self.p
        top, place = self.best(blocks, ptr)
        z = top @ p["weight"] + p["shift"][0]
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) / len(label)
        back = err[:, None] * p["weight"] * (top > 0)
        codes = np.concatenate([blocks[place], blocks[place + 1]], axis=2)  # text, filter, byte of the chunk
        x = p["embed"][codes].reshape(*place.shape, -1)
        dx = (back[:, :, None] * p["filter"].T).reshape(-1, EMBEDDING)
        flat = codes.reshape(-1)
        return {
            "embed": np.stack([np.bincount(flat, dx[:, k], 257) for k in range(EMBEDDING)], axis=1),
            "filter": np.einsum("nfd,nf->df", x, back),
            "bias": back.sum(axis=0),
            "weight": err @ top,
            "shift": err.sum(keepdims=True),
        }


def fit(texts: list[str], labels: list[float], *, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Train with Adam (fixed decay rates 0.9 and 0.999)."""
    net, rng = Network(seed), np.random.default_rng(seed)
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    label = np.array(labels, np.float64)
    first, second = ({k: np.zeros(v.shape) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        for some in (order[i : i + BATCH].tolist() for i in range(0, len(order), BATCH)):
            offs = np.concatenate([[0], np.cumsum([len(raw[i]) for i in some])])
            grad = net.gradients(np.concatenate([raw[i] for i in some]), offs, label[some])
            step += 1
            rate = RATE * (1 - epoch / epochs) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return net


def is_held_out(key: Column) -> Column:
    """Rows whose labels are not learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network | float:
    """A network from a bounded sample of labelled rows, or the share of good rows where one label has none."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality"))
    marks = marks.where(~is_held_out(F.col("doc_id")))
    share = marks.agg(F.avg((F.col("quality") >= 0.5).cast("double"))).first()[0]
    chosen = [r for side in ("quality >= 0.5", "quality < 0.5") for r in marks.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    spark = docs.sparkSession
    ids = spark.createDataFrame([(int(r["doc_id"]), float(r["quality"] >= 0.5)) for r in chosen], "doc_id long, label double")
    rows, size = [], 0
    for r in docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").toLocalIterator():  # at most 2 x sample ids
        size += len(r["text"].encode()) + 64
        if size > sample_bytes:
            break
        rows.append((r["text"], r["label"]))
    if len({y for _, y in rows}) < 2 or not 0 < share < 1:
        return float(np.mean([y for _, y in rows])) if rows else 0.5
    net = fit([t for t, _ in rows], [y for _, y in rows])
    taken = float(np.mean([y for _, y in rows]))  # the sample has as many rows of either label: back to the shares of all labels
    net.p["shift"] += np.float32(np.log(share / (1 - share)) - np.log(taken / (1 - taken)))
    return net


def scorer(net: Network | float):
    """A column function that scores whole texts."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if isinstance(net, float):
            return pa.array(np.full(len(texts), net))
        begin("op5_quality")
        out, at = [], 0
        lengths = np.diff(text_bytes(texts)[1])
        while at < len(texts):  # a few texts at a time
            to = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), 1 << 21, "right")))
            out.append(net.score(*text_bytes(texts.slice(at, to - at))))
            at = to
        release()
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and decision of every document."""
    score = scorer(train(docs, labels))
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score(F.coalesce(F.col("text"), F.lit(""))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier keeps, with their columns."""
    score = scorer(train(docs, labels))
    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) >= GOOD)
