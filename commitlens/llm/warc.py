"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame a record."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import new_folder, partitions, stored

# Fixed values of the WARC and WARC-Zstandard formats.
VERSION = b"WARC/1.1"
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"

DATE = "1970-01-01T00:00:00Z"  # pages carry no time
RECORD_ID = "urn:x-page:"
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 1 << 21, 1 << 15
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 1 << 16
BATCH_BYTES = 4 << 20


class WarcError(ValueError):
    """An archive that breaks the format."""


@dataclass(frozen=True)
class Record:
    page_id: int | None
    url: str | None
    kind: str
    refers_to: int | None
    digest: str
    payload_bytes: int
    payload: bytes | None  # none for a revisit


def record_bytes(record: Record) -> bytes:
    """The record as the format writes it: headers, HTTP headers and payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {record.payload_bytes}\r\n\r\n"
    block = http.encode() + (record.payload or b"")
    fields = [("WARC-Type", record.kind), ("WARC-Record-ID", _name(record.page_id)), ("WARC-Date", DATE)]
    if record.url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in record.url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{record.digest}"))
    if record.kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(record.refers_to))]
    fields += [("Content-Type", HTTP_TYPE), ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return f"<{RECORD_ID}{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    start = "<" + RECORD_ID
    if not name.startswith(start) or not name.endswith(">"):
        raise WarcError(f"not a record id: {name}")
    text = name[len(start) : -1]
    return None if text == "null" else int(text)


def _fields(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.decode().partition(":")
        if not colon or name.lower() in fields:
            raise WarcError(f"a header line is broken or repeated: {name[:60]}")
        fields[name.lower()] = value.strip()
    return fields


def _need(fields: dict[str, str], name: str) -> str:
    if name not in fields:
        raise WarcError(f"the header {name} is missing")
    return fields[name]


def _length(fields: dict[str, str]) -> int:
    text = _need(fields, "content-length")
    if not text.isdigit():
        raise WarcError(f"not a length: {text[:60]}")
    return int(text)


def parse_record(data: bytes) -> Record:
    """One whole record; anything missing, left over or untrue in it is an error."""
    version, _, rest = data.partition(b"\r\n")
    if not version.startswith(b"WARC/1."):
        raise WarcError("a record doesn't begin with its version")
    head, end, rest = rest.partition(b"\r\n\r\n")
    fields = _fields(head)
    length = _length(fields)
    if not end or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, its header says {length}")
    status, _, http = rest[:length].partition(b"\r\n")
    http_head, end, payload = http.partition(b"\r\n\r\n")
    if not status.startswith(b"HTTP/1.") or not end:
        raise WarcError("the block isn't an HTTP response")
    size = _length(_fields(http_head))
    method, _, digest = _need(fields, "warc-payload-digest").partition(":")
    kind = _need(fields, "warc-type")
    _need(fields, "warc-date")
    page, url, refers = _page(_need(fields, "warc-record-id")), fields.get("warc-target-uri"), None
    if kind == "response":
        if len(payload) != size or method != "sha1" or hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("the payload isn't what its length and digest say")
    elif kind == "revisit":
        if payload or fields.get("warc-profile") != REVISIT_PROFILE:
            raise WarcError("a revisit has a payload or no known profile")
        refers = _page(_need(fields, "warc-refers-to"))
    else:
        raise WarcError(f"an unknown kind of record: {kind[:60]}")
    return Record(page, url, kind, refers, digest, size, payload if kind == "response" else None)


def train(samples: list[bytes]) -> bytes:
    """A dictionary for records like ``samples``; none where they are too few to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 10 else b""
    except zstandard.ZstdError:
        return b""


class Archive:
    """Writes one archive. Its first records, a bounded sample, teach its dictionary."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.bytes, self.records, self.held = out, 0, 0, 0
        self.first: list[bytes] | None = []
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, record: Record) -> None:
        data = record_bytes(record)
        self.records += 1
        if self.first is None:
            self._frame(data)
            return
        self.first.append(data)
        self.held += len(data)
        if len(self.first) >= SAMPLES or self.held >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        first, self.first = self.first or [], None
        learned = train([f[: SAMPLE_BYTES // 16] for f in first])
        self._write(struct.pack("<II", DICTIONARY_FRAME, len(learned)) + learned)
        known = {"dict_data": zstandard.ZstdCompressionDict(learned)} if learned else {}
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, **known)
        for data in first:
            self._frame(data)

    def _frame(self, data: bytes) -> None:
        self._write(self.compressor.compress(data))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.first is not None:
            self._begin()


def frames(source: BinaryIO) -> Iterator[bytes]:
    """The content of each frame behind the dictionary frame, which must come first."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_FRAME:
        raise WarcError("the archive doesn't begin with a dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    learned = source.read(size)
    if len(learned) != size:
        raise WarcError("the dictionary frame is cut off")
    if learned[:4] == zstandard.FRAME_HEADER:
        learned = zstandard.ZstdDecompressor().decompress(learned)  # the format allows a compressed dictionary
    known = {"dict_data": zstandard.ZstdCompressionDict(learned)} if learned else {}
    decompressor = zstandard.ZstdDecompressor(**known)
    data = source.read(READ_BYTES)
    while data:
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not data and not (data := source.read(READ_BYTES)):
                raise WarcError("the last frame is cut off")
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as error:
                raise WarcError(f"a frame can't be decoded: {error}") from error
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)
        data = data or source.read(READ_BYTES)


def read_archive(source: BinaryIO) -> Iterator[Record]:
    return map(parse_record, frames(source))


def record_types(pages: DataFrame, least_bytes: int, id_col: str, payload: str) -> DataFrame:
    """``page_id``, ``digest``, ``refers_to`` of the pages that are revisits, once each."""
    found = stored(
        pages.select(F.col(id_col).alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes")), "payloads"
    ).filter(F.col("bytes") >= least_bytes)
    latest = found.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    latest = latest.filter((F.col("n") > 1) & F.col("refers_to").isNotNull())
    revisits = found.select("page_id", "digest").join(latest, "digest")
    return revisits.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_archives(
    pages: DataFrame,
    folder: str,
    least_bytes: int = 1000,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Writes a record for every page; returns the list of archives: ``path``, ``records``.

    Of pages whose payloads (the HTML in UTF-8) are equal and have at least ``least_bytes``, the one
    with the largest id is a response and the others revisit it; smaller ones are all responses.

    A null payload is empty, a null URL leaves its header out. Pages with a null id revisit the
    largest id, if any page with their payload has one, else they are responses. Rows with the same
    id and payload are records alike. White space and control characters of a URL are
    percent-encoded. Other columns are ignored; an empty table gives no archive.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    revisits = record_types(rows, least_bytes, "page_id", "payload")
    revisits = revisits.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to", F.lit(True).alias("revisit"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    typed = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    typed = typed.select("page_id", "url", "revisit", "refers_to", "digest", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        archive = None
        written: list[tuple[str, int]] = []

        def finish() -> None:
            archive.close()
            archive.out.close()
            written.append((path, archive.records))

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page, url, revisit, refers, digest, body = (x.as_py() for x in row)
                if archive is None:
                    path = f"{base}/pages-{context.partitionId():05d}-{context.taskAttemptId()}-{len(written)}.warc.zst"
                    archive = Archive(store.open_output_stream(path))
                kind = "revisit" if revisit else "response"
                archive.add(Record(page, url, kind, refers, digest, len(body), None if revisit else body))
                if archive.bytes >= ARCHIVE_BYTES:
                    finish()
                    archive = None
        if archive is not None:
            finish()
        if written:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*written, strict=True)], ["path", "records"])

    return stored(typed.mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of listed archives, each validated: ``page_id``, ``url``, ``record_type``, ``refers_to``,
    ``payload_bytes``, ``payload_digest`` and, if asked for, ``payload`` (null for a revisit)."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types)], names)  # noqa: B905

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held, found = [], 0, 0
                with store.open_input_stream(path) as source:
                    for r in read_archive(source):
                        row = (r.page_id, r.url, r.kind, r.refers_to, r.payload_bytes, r.digest)
                        rows.append((*row, r.payload) if with_payload else row)
                        held += 100 + (len(r.payload or b"") if with_payload else 0)
                        found += 1
                        if held > BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
                if found != expected:
                    raise WarcError(f"{path} has {found} records, {expected} were written")

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    spread = archives.select("path", "records").repartition(partitions(archives.sparkSession), "path")
    return spread.mapInArrow(run, schema + ", payload binary" * with_payload)


def archive_round_trip(pages: DataFrame, with_payload: bool = True, **options) -> DataFrame:
    """Writes the archives of ``pages`` to the shared folder and reads them back."""
    folder = new_folder(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder, **options), folder, with_payload)
