"""Zstandard WARC archives: writer and reader.

An archive starts with a skippable frame that holds a Zstandard dictionary; then
each record is one frame, compressed with that dictionary. The reader loads the
dictionary, decodes one frame at a time, and checks the version line, the needed
headers, the block's length, its end, and its digests. It reads records of any type and
maker: record ids stay text, and blocks that hold no HTTP message are payloads themselves.

Layout of the archive table and the record types: a payload that an earlier page
(by page_id) has too, of at least ``revisit_bytes``, is a ``revisit`` whose block
holds the HTTP head only; all others are ``response``.

Defined results: a null payload is empty; a very long one is one record; a page without page_id is written, with a
null page_id, as a response; pages of equal page_id and equal payload are all responses if theirs is
the smallest page_id; an empty table gives no archives and no records; other columns, whatever their names, are
not read. A broken archive raises :class:`BadRecord`.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import shared_dir, stored

#: Magic number of the skippable frame for a dictionary, and of a Zstandard frame (fixed values of the formats).
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
#: Payload bytes after which a task starts another archive.
ARCHIVE_BYTES = 16 << 20
#: Payloads, and bytes of each, that a dictionary is trained on.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8192, 16384
#: Smallest payload that is worth a revisit.
REVISIT_BYTES = 100
#: Repeated payloads up to which their digests are broadcast (about 80 bytes each); beyond it the pages are dealt by digest and salt.
REPEATED_ROWS, SALTS = 300_000, 64
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "2024-01-01T00:00:00Z"


class BadRecord(ValueError):
    """An archive that doesn't keep to the format."""


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    """The page of a record id that this writer made; null for any other."""
    name = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name != uri and name.removeprefix("-").isdecimal() else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; ``refers_to`` makes it a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url and url.isprintable():
        fields.append(("WARC-Target-URI", url))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in fields)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """Writes an archive into a binary stream."""

    def __init__(self, out, dictionary: bytes):
        self.out = out
        if dictionary:
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True)

    def write(self, raw: bytes) -> None:
        self.out.write(self.zstd.compress(raw))


class Reader:
    """Iterates over (headers, block) of an archive; holds one record at a time."""

    def __init__(self, stream, buffer: int = 1 << 16):
        self.stream, self.buffer = stream, buffer
        self.rest = b""
        self.dictionary = self._dictionary()

    def _peek(self, n: int) -> bytes:
        while len(self.rest) < n:
            more = self.stream.read(self.buffer)
            if not more:
                break
            self.rest += more
        return self.rest[:n]

    def _take(self, n: int) -> bytes:
        got = self._peek(n)
        if len(got) != n:
            raise BadRecord(f"archive ends within a frame: {len(got)} of {n} bytes")
        self.rest = self.rest[n:]
        return got

    def _dictionary(self) -> zstandard.ZstdCompressionDict | None:
        """The dictionary of the leading skippable frame; it may be compressed itself."""
        head = self._peek(8)
        if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_FRAME:
            return None
        size = struct.unpack("<I", self._take(8)[4:])[0]
        raw = self._take(size)
        if raw[:4] == struct.pack("<I", ZSTD_FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        return zstandard.ZstdCompressionDict(raw)

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        zstd = zstandard.ZstdDecompressor(dict_data=self.dictionary) if self.dictionary else zstandard.ZstdDecompressor()
        while head := self._peek(4):
            magic = struct.unpack("<I", head)[0] if len(head) == 4 else 0
            if 0x184D2A50 <= magic <= 0x184D2A5F:  # other skippable frames
                size = struct.unpack("<I", self._take(8)[4:])[0]
                self._take(size)
                continue
            if magic != ZSTD_FRAME:
                raise BadRecord("no Zstandard frame where a record should start")
            yield parse(self._frame(zstd))

    def _frame(self, zstd: zstandard.ZstdDecompressor) -> bytes:
        one, out = zstd.decompressobj(), []
        while not one.eof:
            if not self._peek(1):
                raise BadRecord("archive ends within a record's frame")
            part, self.rest = self.rest, b""
            try:
                out.append(one.decompress(part))
            except zstandard.ZstdError as e:
                raise BadRecord(f"a record's frame can't be decoded: {e}") from e
        self.rest = one.unused_data
        return b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record, checked."""
    head, mark, body = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadRecord(f"not a WARC record: {raw[:40]!r}")
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        try:
            text = line.decode("utf-8")
        except UnicodeDecodeError as e:
            raise BadRecord(f"a header line isn't UTF-8: {line[:60]!r}") from e
        if name and text[:1] in " \t":  # goes on with the line before
            headers[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise BadRecord(f"bad header line {line[:60]!r}")
        headers[name] = value.strip()
    if lost := [n for n in NEEDED if n not in headers]:
        raise BadRecord(f"header missing: {', '.join(lost)}")
    if not (headers["content-length"].isascii() and headers["content-length"].isdigit()):
        raise BadRecord("Content-Length isn't a number")
    size = int(headers["content-length"])
    if len(body) != size + 4 or body[size:] != b"\r\n\r\n":
        raise BadRecord(f"Content-Length is {size}, the frame holds {len(body) - 4} bytes of block")
    check_digest(headers, "warc-block-digest", body[:size])
    return headers, body[:size]


def check_digest(headers: dict[str, str], name: str, data: bytes) -> None:
    """Compare a digest header in hex or base 32; unknown algorithms are let pass."""
    algorithm, _, stated = headers.get(name, "").partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if not stated or algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return
    raw = hashlib.new(algorithm, data).digest()
    if stated.lower() != raw.hex() and stated.upper().rstrip("=") != base64.b32encode(raw).decode().rstrip("="):
        raise BadRecord(f"{name} doesn't match")


def http_payload(block: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Head fields (lower-case names) and payload of an HTTP message."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark:
        raise BadRecord("no HTTP head in the block")
    fields = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}, payload


def train(samples: list[bytes]) -> bytes:
    """A dictionary from a bounded sample; empty where it is too small to train on."""
    samples = [s for s in samples if s]
    if len(samples) < 20 or sum(map(len, samples)) < 10 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def marked(pages: DataFrame, *, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Pages with payload length, digest, and for repeats the page that has the payload first.

    Only digests that several rows have are joined back.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    repeated = (
        rows.where(F.octet_length("html") >= revisit_bytes)
        .groupBy(F.col("payload_digest").alias("repeated"))
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
        .where("n > 1 and first is not null")
        .drop("n")
    )
    repeated = stored(repeated)
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    if repeated.count() <= REPEATED_ROWS:  # the pages stay where they are
        found = rows.join(F.broadcast(repeated), F.col("payload_digest") == F.col("repeated"), "left")
    else:
        salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        found = rows.join(salted, (F.col("payload_digest") == F.col("repeated")) & (F.col("own") == F.col("salt")), "left")
    return found.select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"))


def write(self, raw: bytes) -> None:
        self.out.write(self.zstd.compress(raw))


class Reader:
    """Iterates over (headers, block) of an archive; holds one record at a time."""

    def __init__(self, stream, buffer: int = 1 << 16):
        self.stream, self.buffer = stream, buffer
        self.rest = b""
        self.dictionary = self._dictionary()

    def _peek(self, n: int) -> bytes:
        while len(self.rest) < n:
            more = self.stream.read(self.buffer)
            if not more:
                break
            self.rest += more
        return self.rest[:n]

    def _take(self, n: int) -> bytes:
        got = self._peek(n)
        if len(got) != n:
            raise BadRecord(f"archive ends within a frame: {len(got)} of {n} bytes")
        self.rest = self.rest[n:]
        return got

    def _dictionary(self) -> zstandard.ZstdCompressionDict | None:
        """The dictionary of the leading skippable frame; it may be compressed itself."""
        head = self._peek(8)
        if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_FRAME:
            return None
        size = struct.unpack("<I", self._take(8)[4:])[0]
        raw = self._take(size)
        if raw[:4] == struct.pack("<I", ZSTD_FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        return zstandard.ZstdCompressionDict(raw)

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        zstd = zstandard.ZstdDecompressor(dict_data=self.dictionary) if self.dictionary else zstandard.ZstdDecompressor()
        while head := self._peek(4):
            magic = struct.unpack("<I", head)[0] if len(head) == 4 else 0
            if 0x184D2A50 <= magic <= 0x184D2A5F:  # other skippable frames
                size = struct.unpack("<I", self._take(8)[4:])[0]
                self._take(size)
                continue
            if magic != ZSTD_FRAME:
                raise BadRecord("no Zstandard frame where a record should start")
            yield parse(self._frame(zstd))

    def _frame(self, zstd: zstandard.ZstdDecompressor) -> bytes:
        one, out = zstd.decompressobj(), []
        while not one.eof:
            if not self._peek(1):
                raise BadRecord("archive ends within a record's frame")
            part, self.rest = self.rest, b""
            try:
                out.append(one.decompress(part))
            except zstandard.ZstdError as e:
                raise BadRecord(f"a record's frame can't be decoded: {e}") from e
        self.rest = one.unused_data
        return b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record, checked."""
    head, mark, body = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadRecord(f"not a WARC record: {raw[:40]!r}")
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        try:
            text = line.decode("utf-8")
        except UnicodeDecodeError as e:
            raise BadRecord(f"a header line isn't UTF-8: {line[:60]!r}") from e
        if name and text[:1] in " \t":  # goes on with the line before
            headers[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise BadRecord(f"bad header line {line[:60]!r}")
        headers[name] = value.strip()
    if lost := [n for n in NEEDED if n not in headers]:
        raise BadRecord(f"header missing: {', '.join(lost)}")
    if not (headers["content-length"].isascii() and headers["content-length"].isdigit()):
        raise BadRecord("Content-Length isn't a number")
    size = int(headers["content-length"])
    if len(body) != size + 4 or body[size:] != b"\r\n\r\n":
        raise BadRecord(f"Content-Length is {size}, the frame holds {len(body) - 4} bytes of block")
    check_digest(headers, "warc-block-digest", body[:size])
    return headers, body[:size]


def check_digest(headers: dict[str, str], name: str, data: bytes) -> None:
    """Compare a digest header in hex or base 32; unknown algorithms are let pass."""
    algorithm, _, stated = headers.get(name, "").partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if not stated or algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return
    raw = hashlib.new(algorithm, data).digest()
    if stated.lower() != raw.hex() and stated.upper().rstrip("=") != base64.b32encode(raw).decode().rstrip("="):
        raise BadRecord(f"{name} doesn't match")


def http_payload(block: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Head fields (lower-case names) and payload of an HTTP message."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark:
        raise BadRecord("no HTTP head in the block")
    fields = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}, payload


def train(samples: list[bytes]) -> bytes:
    """A dictionary from a bounded sample; empty where it is too small to train on."""
    samples = [s for s in samples if s]
    if len(samples) < 20 or sum(map(len, samples)) < 10 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def marked(pages: DataFrame, *, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Pages with payload length, digest, and for repeats the page that has the payload first.

    Only digests that several rows have are joined back.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    repeated = (
        rows.where(F.octet_length("html") >= revisit_bytes)
        .groupBy(F.col("payload_digest").alias("repeated"))
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
        .where("n > 1 and first is not null")
        .drop("n")
    )
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return rows.join(repeated, F.col("payload_digest") == F.col("repeated"), "left").select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"))


def write(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages as archives into a table of archives at ``path``; returns it.

    A row is one whole archive of about ARCHIVE_BYTES of payload, in the file format
    itself. Spark's committer keeps only the files of tasks that ended, so lost
    executors leave no half archive behind.
    """
    rows = marked(pages)
    sample = [r[0].encode()[:SAMPLE_BYTES] for r in pages.where("html is not null").select(F.substring("html", 1, SAMPLE_BYTES).alias("h")).limit(SAMPLES).collect()]
    dictionary = train(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([out.getvalue()], pa.binary())], ["records", "archive"])

        out, n, size, writer = io.BytesIO(), 0, 0, None
        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "payload_digest", "refers_to")), strict=True):
                if writer is None:
                    out, n, size = io.BytesIO(), 0, 0
                    writer = Writer(out, dictionary)
                payload = html.as_py().encode()
                writer.write(record(page.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py()))
                n, size = n + 1, size + len(payload)
                if size >= ARCHIVE_BYTES:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    rows.mapInArrow(run, "records long, archive binary").write.parquet(path)
    return pages.sparkSession.read.schema("records long, archive binary").parquet(path)


RECORD = "record_id string, page_id long, url string, record_type string, refers_to_record string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(archives: DataFrame, *, column: str = "archive", payloads: bool = True) -> DataFrame:
    """Records of archives, checked; ``column`` holds whole archive files (as Spark's binaryFile source gives them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for headers, block in Reader(pa.BufferReader(batch.column("archive")[i].as_buffer())):
                    rows.append(_row(headers, block, payloads))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select(F.col(column).alias("archive")).mapInArrow(run, RECORD)


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, payload, size = headers["warc-type"], block, len(block)
    if headers.get("content-type", "").lower().startswith("application/http") and kind in ("response", "revisit", "request") and block:
        fields, payload = http_payload(block)
        stated, coded = fields.get(b"content-length"), b"transfer-encoding" in fields
        if stated is not None and not stated.isdigit():
            raise BadRecord(f"HTTP Content-Length isn't a number: {stated[:40]!r}")
        size = int(stated) if stated is not None and not coded else len(payload)
        if kind == "response" and len(payload) != size and "warc-truncated" not in headers:
            raise BadRecord(f"the payload has {len(payload)} bytes, its head says {size}")
        if kind == "response" and not coded:
            check_digest(headers, "warc-payload-digest", payload)
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    record, refers = headers["warc-record-id"], headers.get("warc-refers-to")
    return record, page_of(record), headers.get("warc-target-uri"), kind, refers, page_of(refers), size, digest, payload if payloads and kind != "revisit" else None


def export_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file of its own below ``folder`` (a URI that pyarrow can open on all executors); returns their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            paths = []
            for archive in batch.column("archive"):
                raw = archive.as_py()
                path = f"{root}/{hashlib.sha256(raw).hexdigest()}.warc.zst"
                with store.open_output_stream(path + ".part") as out:
                    out.write(raw)
                store.move(path + ".part", path)  # the name comes from the content: a task that runs again writes the same file
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return archives.select("archive").mapInArrow(run, "path string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``*.warc.zst`` files at a path that Spark can read."""
    return read(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path), column="content")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives to the shared folder and read them back: one row per page."""
    archives = write(pages, shared_dir(pages.sparkSession))
    return read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
