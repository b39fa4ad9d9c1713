"""Toxicity by logistic regression on hashed word n-grams and skip-grams, trained with FTRL-proximal."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import modest_batches, stored

WORD = re.compile(r"\w+")
KEPT_WORDS = 300_000
PART = 1 << 20  # characters of a long text that are split at once
SEGMENTS = 64  # parts of the weights that are merged apart
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_NEXT, _OVER = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Options:
    """``sample_rows`` labelled documents, taken by a hash of their ids, are all that is fitted on."""

    sample_rows: int = 20_000
    shard_rows: int = 2_500  # documents that one task learns from, one after another
    epochs: int = 5
    bits: int = 18  # slots of features, as a power of two
    alpha: float = 3.0  # learning rate
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.3


class Hashes(dict):
    """64-bit hashes of words, each worked out when first met."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def _parts(text: str) -> Iterator[str]:
    """``text`` in parts that end behind a word."""
    start = 0
    while len(text) - start > PART:
        found = WORD.search(text, start + PART)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


def slots(text: str, hashes: Hashes, bits: int) -> np.ndarray:
    """The different features of a whole text: its words, neighbouring pairs, and pairs with one word between."""
    found = []
    last = np.zeros(0, np.uint64)
    shift = np.uint64(64 - bits)
    for part in _parts(text.lower()):
        words = WORD.findall(part)
        new = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        h = np.concatenate([last, new])
        here = [new * _SPREAD, (h[:-1] * _NEXT + h[1:]) * _SPREAD, (h[:-2] * _OVER + h[2:]) * _SPREAD]
        found.append(np.unique(np.concatenate([x >> shift for x in here]).astype(np.uint32)))
        last = h[-2:]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _weights(z: np.ndarray, n: np.ndarray, options: Options) -> np.ndarray:
    """The proximal step: 0 where ``z`` is within L1, which a text must outweigh."""
    w = -(z - np.sign(z) * options.l1) / ((options.beta + np.sqrt(n)) / options.alpha + options.l2)
    return np.where(np.abs(z) <= options.l1, 0.0, w)


def _chance(logit: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -35.0, 35.0)))


def learn(z: np.ndarray, n: np.ndarray, rows: Iterator[tuple[np.ndarray, int]], options: Options) -> np.ndarray:
    """FTRL-proximal over ``rows`` (slots, label), one by one; changes ``z`` and ``n``, tells the coordinates met.

    Each coordinate has its own learning rate, from the sum of its squared gradients. The last coordinate
    is the constant, on which L1 doesn't weigh.
    """
    met = np.zeros(len(z), bool)
    bias = len(z) - 1
    rate = lambda n: (options.beta + np.sqrt(n)) / options.alpha + options.l2
    for at, label in rows:
        w = _weights(z[at], n[at], options)
        constant = -z[bias] / rate(n[bias])
        g = _chance(w.sum() + constant) - label
        for place, weight in ((at, w), (bias, constant)):
            more = np.sqrt(n[place] + g * g)
            z[place] += g - (more - np.sqrt(n[place])) / options.alpha * weight
            n[place] += g * g
        met[at] = True
        met[bias] = True
    return met


@dataclass(frozen=True)
class Model:
    """The weights that aren't 0, by slot, and the constant; ``constant`` is None if there was nothing to learn from."""

    bits: int
    slots: np.ndarray
    weights: np.ndarray
    constant: float | None

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.slots] = self.weights
        return out


def sample(docs: DataFrame, labels: DataFrame, options: Options, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``doc_id``, ``text``, ``label`` of at most ``sample_rows`` labelled ids; of several labels the largest counts."""
    named = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    each = named.groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    taken = each.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(options.sample_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The sample has a bound, so it may go to every task; the texts stay where they are.
    return texts.join(F.broadcast(stored(taken, "labels")), "doc_id")


_PARTS = pa.schema([("segment", pa.int32()), ("at", pa.binary()), ("z", pa.binary()), ("n", pa.binary())])
_SHAPE = "segment int, at binary, z binary, n binary"
_LISTS = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()))


def _width(size: int) -> int:
    return -(-size // SEGMENTS)


def _written(slots: np.ndarray) -> bytes:
    """Ascending slots as the steps between them, of two bytes where all fit."""
    steps = np.diff(slots, prepend=slots.dtype.type(0))
    kind = "<u2" if steps.max(initial=0) < 1 << 16 else "<u4"
    return kind[-1].encode() + steps.astype(kind).tobytes()


def _read(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[:1].decode()}", offset=1), dtype=np.int64)


def _shard(rows: pa.Table) -> pa.Table:
    """The documents of a shard as one row, so that an epoch shuffles none of them."""
    order = pa.array(np.lexsort((np.asarray(rows.column("label")), np.asarray(rows.column("key")))))
    lists = {c: pa.array([rows.column(c).take(order).to_pylist()], t) for c, t in zip(("key", "label", "slots"), _LISTS, strict=True)}
    return pa.table({"shard": rows.column("shard")[:1].combine_chunks(), **lists})


def _trainer(state: Broadcast, epoch: int, options: Options) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Learns from the documents of each shard, going on from ``state``; gives the coordinates met, by segment."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                z, n = (x.copy() for x in state.value)
                key, label, slots = (batch.column(c)[i].values for c in ("key", "label", "slots"))
                label = np.asarray(label)
                # Another order in each epoch, the same in every run.
                turn = np.asarray(key).view(np.uint64) * np.uint64(2 * epoch + 1)
                rows = ((_read(slots[j].as_py()), int(label[j])) for j in np.lexsort((label, turn)).tolist())
                met = learn(z, n, rows, options)
                width, segments = _width(len(z)), []
                for s in range(SEGMENTS):
                    at = np.flatnonzero(met[s * width : (s + 1) * width])
                    segments.append((s, at.astype(np.uint32).tobytes(), z[s * width + at].tobytes(), n[s * width + at].tobytes()))
                columns = zip(zip(*segments, strict=True), _PARTS.types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], _PARTS.names)

    return train


def _merged(segment: pa.Table) -> pa.Table:
    """Of each coordinate of a segment the mean over the shards that met it."""
    kinds = (("at", np.uint32), ("z", np.float64), ("n", np.float64))
    columns = [np.frombuffer(b"".join(segment.column(c).to_pylist()), t) for c, t in kinds]
    order = np.lexsort(columns[::-1])  # sums go through equal numbers in equal order
    at, *sums = (c[order] for c in columns)
    places, starts, many = np.unique(at, return_index=True, return_counts=True)
    means = [np.add.reduceat(x, starts) / many if len(x) else x for x in sums]
    packed = {k: [x.tobytes()] for k, x in zip(("at", "z", "n"), [places, *means], strict=True)}
    return pa.table({"segment": segment.column("segment")[:1].combine_chunks(), **packed}, schema=_PARTS)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    options: Options = Options(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Learns from the texts of ``docs`` whether ``label_col`` is above 0 in ``labels`` of the same id.

    Documents are dealt to shards. In each epoch every shard goes on from the weights of the one before,
    document by document; then a coordinate becomes the mean of the shards that met it. Equal
    rows of ``docs`` count once, null ids and labels not at all, other columns are ignored. The state has a fixed
    size, two numbers a slot.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    size = (1 << options.bits) + 1
    width = _width(size)
    rows = sample(docs, labels, options, id_col, text_col, label_col)
    key = F.xxhash64("doc_id", "text").alias("key")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            found = [_written(slots(t.as_py(), hashes, options.bits)) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "label", "slots"])

    shards = -(-rows.select(key).distinct().count() // options.shard_rows)
    if not shards:
        return Model(options.bits, np.zeros(0, np.uint32), np.zeros(0), None)
    encoded = rows.select(key, "label", "text").mapInArrow(encode, "key long, label int, slots binary")
    encoded = encoded.dropDuplicates(["key", "label"])
    dealt = encoded.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "label", "slots")
    packed = dealt.groupBy("shard").applyInArrow(_shard, "shard int, key array<long>, label array<int>, slots array<binary>")
    packed = stored(packed, "shards")

    z, n = np.zeros(size), np.zeros(size)
    for epoch in range(options.epochs):
        state = spark.sparkContext.broadcast((z, n))
        learnt = packed.mapInArrow(_trainer(state, epoch, options), _SHAPE)
        for row in learnt.groupBy("segment").applyInArrow(_merged, _SHAPE).collect():
            at = row["segment"] * width + np.frombuffer(row["at"], np.uint32).astype(np.int64)
            z[at], n[at] = np.frombuffer(row["z"]), np.frombuffer(row["n"])
        state.unpersist()
    weights = _weights(z[:-1], n[:-1], options)
    kept = np.flatnonzero(weights).astype(np.uint32)
    return Model(options.bits, kept, weights[kept], float(-z[-1] / ((options.beta + np.sqrt(n[-1])) / options.alpha + options.l2)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score``: how likely the label 1 is, from the whole text and nothing else.

    A null text is empty and gets the score of the constant, as does one without known features; a
    model that had nothing to learn from gives 0. Null ids and repeated rows are documents like others, other columns
    are ignored; an empty table gives an empty result. The weights go to every task: at most a number a slot.
    """
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights = Hashes(), model.dense()
        for batch in batches:
            found = np.zeros(batch.num_rows)
            if model.constant is not None:
                for i, text in enumerate(batch.column(1)):
                    known = weights[slots(text.as_py() or "", hashes, model.bits)]
                    found[i] = _chance(known[known != 0].sum() + model.constant)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    doc_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {doc_type}, score double")
