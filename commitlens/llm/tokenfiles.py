"""Token ids in binary files: patched frame-of-reference blocks with an index of their starts.

A file is ``MAGIC``, blocks, index, trailer, all little-endian. The ids of its documents, end to
end, are cut into blocks of ``BLOCK`` (the last is filled up with its last id):

    minimum u32, width u8, exceptions u16, packed differences, exceptions' places u16, their high bits u32

A difference is an id less the block's minimum. ``width`` holds the differences up to a percentile;
the low ``width`` bits are packed plane by plane (bit 0 of all differences, bit 1, ...), what larger
ones have above goes to the exception list. The index has the byte at which each block starts
(u64), then the documents: id known (u8), id (i64), number of ids (u64). The trailer has the numbers
of blocks, documents and ids, the byte where the index starts (u64 each) and ``MAGIC``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import modest_batches, new_folder, partitions, stored
from commitlens.llm.tokens import BATCH_BYTES, CACHE_BYTES, ID, encoder

MAGIC = b"PFORIDS1"
BLOCK = 512
PERCENTILE = 95
HEADER = struct.Struct("<IBH")
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("count", "<u2")])
EXCEPTION = 6  # bytes of a place and its high bits
TRAILER = struct.Struct("<QQQQ8s")
CHUNK = 512  # blocks that are packed or unpacked at once


class FileError(ValueError):
    """A file that breaks the format."""


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """``ids``, a multiple of ``BLOCK``, as blocks."""
    table = ids.astype(np.uint32).reshape(-1, BLOCK)
    least = table.min(axis=1)
    above = table - least[:, None]
    at = BLOCK * PERCENTILE // 100 - 1
    typical = np.partition(above, at, axis=1)[:, at]
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.int64)
    high = np.where(width[:, None] < 32, above >> np.minimum(width, 31).astype(np.uint32)[:, None], 0).astype(np.uint32)
    row, place = np.nonzero(high)
    count = np.bincount(row, minlength=len(table))
    plane = BLOCK // 8
    sizes = HEADER.size + width * plane + count * EXCEPTION
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    heads = np.zeros(len(table), HEAD)
    heads["least"], heads["width"], heads["count"] = least, width, count
    _spread(out, starts, heads.view(np.uint8).reshape(-1, HEADER.size))
    for w in np.unique(width):
        rows = np.nonzero(width == w)[0]
        if w:
            low = above[rows].astype(np.uint16 if w <= 16 else np.uint32)
            planes = [np.packbits(low & low.dtype.type(1 << k) != 0, axis=1) for k in range(w)]
            _spread(out, starts[rows] + HEADER.size, np.concatenate(planes, axis=1))
    body = starts + HEADER.size + width * plane
    nth = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    _spread(out, body[row] + 2 * nth, place.astype("<u2").view(np.uint8).reshape(-1, 2))
    _spread(out, (body + 2 * count)[row] + 4 * nth, high[row, place].astype("<u4").view(np.uint8).reshape(-1, 4))
    data = out.tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]


def _spread(out: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> None:
    """Puts each of ``rows`` where it starts."""
    out[starts[:, None] + np.arange(rows.shape[1])] = rows


def _gathered(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    return data[starts[:, None] + np.arange(size)]


def decode_blocks(data: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks of ``data`` that begin at ``starts``."""
    raw, at = np.frombuffer(data, np.uint8), np.array(starts, np.int64)
    heads = _gathered(raw, at, HEADER.size).view(HEAD).ravel()
    width, count = heads["width"].astype(np.int64), heads["count"].astype(np.int64)
    table = np.zeros((len(starts), BLOCK), np.uint32)
    plane = BLOCK // 8
    for w in np.unique(width):
        rows = np.nonzero(width == w)[0]
        if not w:
            continue
        bits = _gathered(raw, at[rows] + HEADER.size, w * plane).reshape(len(rows), w, plane)
        values = np.zeros((len(rows), BLOCK), np.uint32)
        for k in range(w):
            values |= np.unpackbits(bits[:, k], axis=1).astype(np.uint32) << np.uint32(k)
        table[rows] = values
    row = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    body = at + HEADER.size + width * plane
    places = _gathered(raw, body[row] + 2 * nth, 2).view("<u2").ravel()
    if places.max(initial=0) >= BLOCK:
        raise FileError("an exception lies outside its block")
    high = _gathered(raw, (body + 2 * count)[row] + 4 * nth, 4).view("<u4").ravel()
    table[row, places] |= high << width[row].astype(np.uint32)
    table += heads["least"][:, None]
    return table.ravel()


class Writer:
    """Writes one file; blocks leave memory as they fill up."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.at = out, len(MAGIC)
        self.starts: list[int] = []
        self.docs: list[tuple[bool, int, int]] = []
        self.waiting: list[bytes] = []
        self.held = self.ids = 0
        out.write(MAGIC)

    def add(self, doc: int | None, ids: bytes) -> None:
        n = len(ids) // ID.itemsize
        self.docs.append((doc is not None, doc or 0, n))
        self.waiting.append(ids)
        self.ids += n
        self.held += n
        if self.held >= BLOCK * CHUNK:
            self._flush(final=False)

    def _flush(self, final: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), ID)
        whole = len(ids) - len(ids) % BLOCK
        self.waiting = [ids[whole:].tobytes()]
        self.held = len(ids) - whole
        chunks = [ids[i : min(i + BLOCK * CHUNK, whole)] for i in range(0, whole, BLOCK * CHUNK)]
        if final and self.held:
            rest = ids[whole:]
            chunks.append(np.concatenate([rest, np.full(BLOCK - len(rest), rest[-1], rest.dtype)]))
        for chunk in chunks:
            for block in encode_blocks(chunk):
                self.starts.append(self.at)
                self.out.write(block)
                self.at += len(block)

    def close(self) -> None:
        self._flush(final=True)
        known, docs, sizes = (np.array(c) for c in zip(*self.docs, strict=True)) if self.docs else ([], [], [])
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array(known, "u1").tobytes() + np.array(docs, "<i8").tobytes() + np.array(sizes, "<u8").tobytes())
        self.out.write(TRAILER.pack(len(self.starts), len(self.docs), self.ids, self.at, MAGIC))


def read_documents(source: pa.NativeFile) -> Iterator[tuple[int | None, int, bytes]]:
    """``doc_id``, ids before it in this file, and its ids, document by document."""
    size = source.size()
    if size < len(MAGIC) + TRAILER.size:
        raise FileError("the file is too short")
    blocks, docs, ids, index, magic = TRAILER.unpack(source.read_at(TRAILER.size, size - TRAILER.size))
    if magic != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC or index + 8 * blocks + 17 * docs + TRAILER.size != size:
        raise FileError("not a whole file of token ids")
    head = source.read_at(8 * blocks + 17 * docs, index)
    starts = [*np.frombuffer(head, "<u8", blocks).tolist(), index]
    known = np.frombuffer(head, "u1", docs, 8 * blocks)
    names = np.frombuffer(head, "<i8", docs, 8 * blocks + docs)
    sizes = np.frombuffer(head, "<u8", docs, 8 * blocks + 9 * docs).tolist()
    if sum(sizes) != ids or not ids <= blocks * BLOCK < ids + BLOCK:
        raise FileError("the index doesn't add up")

    def decoded() -> Iterator[np.ndarray]:
        for first in range(0, blocks, CHUNK):
            last = min(first + CHUNK, blocks)
            data = source.read_at(starts[last] - starts[first], starts[first])
            yield decode_blocks(data, [s - starts[first] for s in starts[first:last]])

    chunks, have, start = decoded(), np.zeros(0, np.uint32), 0
    for i, n in enumerate(sizes):
        held = [have]
        missing = n - len(have)
        while missing > 0:
            held.append(next(chunks))
            missing -= len(held[-1])
        have = np.concatenate(held) if len(held) > 1 else have
        yield (int(names[i]) if known[i] else None), start, have[:n].astype(ID).tobytes()
        have = have[n:]
        start += n


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    cache_bytes: int = CACHE_BYTES,
) -> DataFrame:
    """Writes every document's ids and an end id in ascending id order; returns the list of files.

    ``part`` (files in order), ``path``, ``docs``, ``ids``. Documents are sorted by range, so a
    file continues the one before. A file is named for the attempt that wrote it and counts only
    if the list names it, so a repeated task does no harm. ``folder`` is any that pyarrow reaches.

    Integer ids. A null text is the end id alone; documents with a null id come last; rows with
    the same id are ordered by text. An empty table writes at most empty files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encode, end = encoder(vocabulary, cache_bytes).encode_all, np.array([end_id], ID).tobytes()
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/ids-{context.partitionId():05d}-{context.taskAttemptId()}.pfor"
        with store.open_output_stream(path) as out:
            writer = Writer(out)
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), encode([text or "" for text in batch.column(1).to_pylist()]), strict=True):
                    writer.add(doc, ids + end)
            writer.close()
        row = [[context.partitionId()], [path], [len(writer.docs)], [writer.ids]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["part", "path", "docs", "ids"])

    modest_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    ordered = texts.repartitionByRange(partitions(docs.sparkSession), *order)
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    return stored(ordered.mapInArrow(run, "part long, path string, docs long, ids long"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids`` of listed files.

    The running sum over files sees one row a file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for doc, start, ids in read_documents(source):
                        rows.append((doc, base + start, len(ids) // ID.itemsize, ids))
                        held += len(ids)
                        if held > BATCH_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    spread = based.repartition(partitions(files.sparkSession), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids"])


def token_round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Writes the files of ``docs`` to the shared folder and reads them back."""
    folder = new_folder(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, folder, vocabulary, **options), folder)
