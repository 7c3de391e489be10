"""Byte-level BPE by a bounded-lookahead transducer, and its inverse.

Encoding. A token ``t`` is the last one of the encoding of a prefix exactly when
it is a suffix of the prefix and stands stably beside the last token of what is
left of it: two neighbours are stable if no merge ever happens across their
border. So one step per byte finds the last token of every prefix. Tokens are
emitted once all live chains of last tokens go through them: an encoding changes
only within a bounded distance of its end, as a change travels leftwards only
through merges of ever smaller rank that overlap each other. ``lookahead`` of a
:class:`Merges` is that bound, computed from the merge list. The transducer keeps
one entry per byte of that window, however long a run of letters is.

Cutting into pretokens. Letters, digits, other marks and white space are told
apart by a table over code points, and the borders found for a whole chunk of
texts at once. Every pretoken, long or short, goes through the transducer once; the ids of short
ones are kept in a memo that is keyed by their bytes and bounded in entries and bytes.

Decoding. Ids are fed to an incremental UTF-8 state machine in windows of a fixed
size; it replaces maximal invalid parts by U+FFFD.

Defined results: a null or empty text has no tokens, and the empty string's
digests; repeated rows give repeated rows; a very long text is encoded whole, its window as small as any
other's; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quantloom.llm.common import joined, kept_by, pieces, spread, text_bytes, tidy

#: Pretokens in each of the memo's two generations, and their most bytes; what a full generation doesn't use goes with the next.
MEMO, MEMO_BYTES = 120_000, 256
#: Pairs of tokens whose stability a worker remembers.
PAIRS = 250_000
#: Ids that are decoded at a time.
DECODED = 1 << 16


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary with its ranked merges, prepared for left-to-right encoding."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.special = dict(special or {})
        self.bytes_of: dict[int, bytes] = {i: b for b, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, r)
            made.setdefault(vocab[a + b], (r, *pair))
        self.made = made
        #: Edges of each token's merge tree, outermost last: (token, rank at which it goes up into its parent).
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._stable: dict[int, bool] = {}
        self._n = max(self.bytes_of) + 1
        self._pieces: Pieces | None = None
        #: Tokens that the merges really make from their own bytes.
        self.token = {b: i for b, i in vocab.items() if len(b) == 1 or (i in made and self._whole(b, i))}
        self.longest = max(map(len, self.token))
        self.lookahead = self._lookahead()
        #: Lengths of the tokens that may end with these last three bytes, longest first.
        tails: dict[bytes, set[int]] = {}
        for t in self.token:
            if len(t) > 2:
                tails.setdefault(t[-3:], {1}).add(len(t))
        self.tails = {k: tuple(sorted(v | ({2} if k[1:] in self.token else set()), reverse=True)) for k, v in tails.items()}

    def pieces(self) -> Pieces:
        if self._pieces is None:
            self._pieces = Pieces([self.bytes_of.get(i, b"") for i in range(self._n)])
        return self._pieces

    def _spine(self, token: int, side: int, memo: dict) -> list[tuple[int, float]]:
        known = memo.get(token)
        if known is None:
            chain, at = [(token, float("inf"))], token
            while at in self.made:
                rank, at = self.made[at][0], self.made[at][side]
                chain.append((at, rank))
            known = memo[token] = chain[::-1]
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes and b's bytes together is a, b."""
        key = a * self._n + b
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > PAIRS:
                self._stable.clear()
            known = self._stable[key] = self._beside(a, b)
        return known

    def _beside(self, a: int, b: int) -> bool:
        """Walk both edges of the border upwards in the order of the merges."""
        left, right = self._spine(a, 2, self._right), self._spine(b, 1, self._left)
        i = j = 0
        while True:
            (x, up), (y, high) = left[i], right[j]
            across = self.rank.get((x, y))
            # of equal ranks the leftmost merges first: a's own before the border's, the border's before b's
            if across is not None and across < up and across <= high:
                return False
            if up == high == float("inf"):
                return True
            if up <= high:
                i += 1
            else:
                j += 1

    def _whole(self, text: bytes, token: int) -> bool:
        rank, a, b = self.made[token]
        left, right = self._spine(a, 2, self._right), self._spine(b, 1, self._left)
        i = j = 0
        while (i, j) != (len(left) - 1, len(right) - 1):
            (x, up), (y, high) = left[i], right[j]
            across = self.rank.get((x, y))
            if across is not None and across < up and across <= high:
                return False
            if up <= high:
                i += 1
            else:
                j += 1
        return True

    def _lookahead(self) -> int:
        """Bytes before the end of a prefix that later bytes can still change.

        A later byte takes a token from a merge of higher rank; its left part is
        then free for another merge of still higher rank on its left, and so on:
        a chain of rising ranks in which each merge's right part starts with the
        left part of the one before. The longest chain, in bytes, is the bound;
        it is found in one pass over the merges by rank.
        """
        reach: dict[int, int] = {}
        most = 0
        for _, a, b in sorted(self.made.values()):
            right = max(reach.get(s, 0) for s, _ in self._spine(b, 1, self._left))
            chain = len(self.bytes_of[a]) + max(right, len(self.bytes_of[b]))
            reach[a] = max(reach.get(a, 0), chain)
            most = max(most, chain)
        return most + self.longest


class Transducer:
    """Encodes one pretoken fed in parts; ``feed`` and ``finish`` return tokens that are final."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.text = b""
        self.last: list[int] = []
        self.before: int | None = None

    def feed(self, part: bytes) -> list[int]:
        """Tokens that no further byte can change; holds at most twice the lookahead and one token."""
        wide, out = self.m.lookahead, []
        if len(self.text) + len(part) < wide:
            self._step(part)
            return out
        for at in range(0, len(part), wide):
            self._step(part[at : at + wide])
            if len(self.text) >= 2 * wide:
                out += self._emit(wide)
        return out

    def _step(self, part: bytes) -> None:
        """Find the last token of every prefix that ends in ``part``."""
        m, last, before = self.m, self.last, self.before
        text = self.text = self.text + part
        token, tails, stable, known, n = m.token, m.tails, m.stable, m._stable, m._n
        for i in range(len(last) + 1, len(text) + 1):
            for size in tails.get(text[i - 3 : i], (2, 1)) if i > 2 else (2, 1):
                j = i - size
                if j < 0:
                    continue
                t = token.get(text[j:i])
                if t is None:
                    continue
                left = last[j - 1] if j else before
                if left is None:
                    break
                ok = known.get(left * n + t)
                if stable(left, t) if ok is None else ok:
                    break
            last.append(t)

    def _chain(self, n: int) -> list[tuple[int, int]]:
        out = []
        while n > 0:
            t = self.last[n - 1]
            out.append((n, t))
            n -= len(self.m.bytes_of[t])
        return out[::-1]

    def _emit(self, keep: int) -> list[int]:
        """Emit what ends before the last ``keep`` bytes and lies on every live chain."""
        n = len(self.text)
        common: set[tuple[int, int]] | None = None
        for end in range(max(1, n - self.m.longest + 1), n + 1):
            chain = set(self._chain(end))
            common = chain if common is None else common & chain
        done, out = 0, []
        for end, t in self._chain(n):
            if end > n - keep or (end, t) not in (common or ()):
                break
            out.append(t)
            done, self.before = end, t
        self.text = self.text[done:]
        del self.last[:done]
        return out

    def finish(self) -> list[int]:
        out, n, bytes_of, last = [], len(self.text), self.m.bytes_of, self.last
        while n > 0:
            t = last[n - 1]
            out.append(t)
            n -= len(bytes_of[t])
        self.text, self.last, self.before = b"", [], None
        return out[::-1]


class Pieces:
    """The bytes of every id end to end, for gathering those of many ids at once."""

    def __init__(self, items: list[bytes]):
        self.ptr = np.zeros(len(items) + 1, np.int64)
        np.cumsum([len(x) for x in items], out=self.ptr[1:])
        self.data = np.frombuffer(b"".join(items), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        return self.data[spread(self.ptr, ids)[0]].tobytes()


class Decoder:
    """Incremental bytes-to-text state machine over token ids."""

    def __init__(self, merges: Merges):
        self._pieces = merges.pieces()
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self._state.decode(self._pieces.of(np.asarray(ids, np.int64)))

    def finish(self) -> str:
        """The end of the text; the machine is ready for another one."""
        out = self._state.decode(b"", True)
        self._state.reset()
        return out

    def texts(self, ids: np.ndarray) -> Iterator[str]:
        """The text of all ids in parts of bounded size."""
        for at in range(0, len(ids), DECODED):
            yield self.feed(ids[at : at + DECODED])
        yield self.finish()


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    """Merges of a byte-level tokenizer file; the file is read where the task runs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    raw = lambda s: bytes(alphabet[c] for c in s)
    special = {a["content"]: a["id"] for a in spec["added_tokens"]}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else m for m in spec["model"]["merges"]]
    vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    return Merges(vocab, [(raw(a), raw(b)) for a, b in pairs], special)


LETTER, DIGIT, OTHER, SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Kind of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    valid = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, valid))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[valid[m.start()] : valid[m.end() - 1] + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


#: Endings that stand alone after an apostrophe (fixed values of the pretokenizer).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of all pretoken starts in texts end to end, and per text the first of them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = kinds()[points]
    n = len(points)
    heads = np.zeros(n + 1, bool)
    heads[np.searchsorted(at, offs[:-1][offs[1:] > offs[:-1]])] = True
    heads[n] = True
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= heads[:-1]
    space = kind == SPACE
    ends_run = np.ones(n, bool)  # the last of a run of one kind
    ends_run[:-1] = start[1:]
    # white space before something else of the same text: its last one stands apart
    tail = space & ends_run & ~heads[1:]
    start |= tail
    # a blank there goes to what follows
    blank = tail & (points == 32)
    glued = np.flatnonzero(blank) + 1
    start[glued] = False
    # contractions: an apostrophe that starts a pretoken, alone among other marks
    marks = np.flatnonzero(start & (points == 39) & ends_run)
    marks = marks[marks + 1 < n]
    marks = marks[~heads[marks + 1]]
    for tail_text in CONTRACTIONS:
        if not len(marks):
            break
        ok = marks + len(tail_text) < n
        for i, c in enumerate(tail_text, 1):
            where = np.minimum(marks + i, n - 1)
            ok &= (points[where] == ord(c)) & ~heads[where]
        hit = marks[ok]
        start[hit + 1] = False
        after = hit + len(tail_text) + 1
        after = after[after < n]
        rest = kind[after] == LETTER
        start[after[rest]] = True
        marks = marks[~ok]
    begins = at[start]
    return begins, np.searchsorted(begins, offs)


class Encoder:
    """Encodes chunks of texts; keeps a bounded memo of pretokens."""

    def __init__(self, merges: Merges, memo: int = MEMO):
        self.m, self.limit = merges, memo
        self.machine = Transducer(merges)
        self.numbers = Pieces([f"{i},".encode() for i in range(max(merges.bytes_of) + 1)])
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.memo: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}

    def pretoken(self, text: bytes) -> list[int]:
        out = self.machine.feed(text)
        out += self.machine.finish()
        return out

    def chunk(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts end to end, and per text the first."""
        if self.special is not None and any(s.encode() in data.tobytes() for s in self.m.special):
            return self._with_special(data, offs)
        return self._plain(data, offs)

    def _with_special(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, ptr = [], [0]
        for a, b in zip(offs[:-1], offs[1:], strict=True):
            text, ids, at = data[a:b].tobytes().decode("utf-8"), [], 0
            for m in self.special.finditer(text):
                ids += [self._one(text[at : m.start()]), np.array([self.m.special[m[0]]], np.int64)]
                at = m.end()
            ids.append(self._one(text[at:]))
            out.append(np.concatenate(ids))
            ptr.append(ptr[-1] + len(out[-1]))
        return joined(out, np.int64), np.array(ptr, np.int64)

    def _one(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self._plain(raw, np.array([0, len(raw)], np.int64))[0]

    def _plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins, first = pretokens(data, offs)
        if not len(begins):
            return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        raw, memo, older = data.tobytes(), self.memo, self.older
        edges = begins.tolist()
        ids: list[int] = []
        counts: list[int] = []
        for a, b in zip(edges, [*edges[1:], len(raw)], strict=True):
            text = raw[a:b]
            known = memo.get(text)
            if known is None:
                known = older.get(text)
                if known is None:
                    known = tuple(self.pretoken(text))
                if b - a <= MEMO_BYTES:
                    if len(memo) >= self.limit:
                        older, memo = memo, {}
                        self.older, self.memo = older, memo
                    memo[text] = known
            ids += known
            counts.append(len(known))
        bounds = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=bounds[1:])
        return np.array(ids, np.int64), bounds[first]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder of a Python worker; its memo serves all of the worker's tasks."""
    return Encoder(load(path))


def _forget() -> None:
    load.cache_clear()
    encoder_of.cache_clear()


kept_by("op9_bpe", _forget)


def encode_text(text: str, encoder: Encoder) -> list[int]:
    """Token ids of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return encoder.chunk(raw, np.array([0, len(raw)], np.int64))[0].tolist()


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(batch: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
    """Counts and digests of the token ids and of the decoded texts of one piece of a batch."""
    ids, first = encoder.chunk(*text_bytes(batch.column("text")))
    listed, decoded, decoder = [], [], Decoder(encoder.m)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = ids[a:b]
        listed.append(hashlib.sha256(encoder.numbers.of(own)[:-1]).hexdigest())
        digest = hashlib.sha256()
        for part in decoder.texts(own):
            digest.update(part.encode())
        decoded.append(digest.hexdigest())
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def tokenize(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text with the tokenizer file at ``tokenizer`` (a path on each executor) and decode it again."""

    @tidy("op9_bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield digests(piece, encoder)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text as an array."""

    @tidy("op9_bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, first = encoder.chunk(*text_bytes(piece.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), lists], ["doc_id", "ids"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of arrays of token ids (null: empty)."""

    @tidy("op9_bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Decoder(load(tokenizer))
        for batch in batches:
            out = ["".join(machine.texts(np.array(row.as_py() or (), np.int64))) for row in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select(tokens[key].cast("long").alias("doc_id"), tokens[ids].alias("ids")).mapInArrow(run, "doc_id long, text string")
