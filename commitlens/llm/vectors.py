"""What the vector searches share: usable vectors, classes of equal ones, blocks, best lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK = 2048, 512  # vectors that are multiplied at once


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null, infinite or undefined components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def classes(vectors: DataFrame, members: int) -> DataFrame:
    """``vector`` and ``ids``: each distinct vector with its ``members`` smallest ids.

    ``vectors`` has ``id`` and ``vector``. Of equal vectors only so many smallest ids can be among
    the best of any query; a class that holds a third of the table is cut down in every task before
    its rows meet.
    """
    key = F.hash("vector").alias("salt_key")
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    rows = vectors.select("id", "vector", key, salt.alias("salt")).distinct()
    by_part = Window.partitionBy("salt_key", "salt", "vector").orderBy("id")
    part = rows.withColumn("nth", F.row_number().over(by_part)).filter(F.col("nth") <= members)
    whole = Window.partitionBy("vector").orderBy("id")
    best = part.withColumn("nth", F.row_number().over(whole)).filter(F.col("nth") <= members)
    return best.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def blocks(rows: DataFrame, count: int, *columns: str, size: int = BLOCK) -> DataFrame:
    """``rows`` in blocks of about ``size``: a list of each column. ``count`` is the number of rows."""
    dealt = F.pmod(F.xxhash64(*columns), F.lit(max(1, -(-count // size))))
    return rows.groupBy(dealt.alias("block")).agg(F.collect_list(F.struct(*columns)).alias("rows")).select(
        "block", *[F.col(f"rows.{c}").alias(c) for c in columns]
    )


def matrix(lists: pa.ListArray, dtype: type = np.float64) -> np.ndarray:
    """A list of vectors as rows; shorter ones end in zeros, which add nothing to a product."""
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), dtype)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = min(a.shape[1], b.shape[1])
    return np.ascontiguousarray(a[:, :width]), np.ascontiguousarray(b[:, :width])


def best_of(found: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best rows of each query, ties to smaller ids.

    ``found`` has no query in more rows than the blocks it met times a few ``k``.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def best_rows(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best entries of each of ``at``, best first, ties to smaller ids.

    An entry met in several lists counts once, though its score may differ in the last bit.
    """
    order = np.lexsort((-scores, ids, at))
    at, ids, scores = at[order], ids[order], scores[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])
    at, ids, scores = at[new], ids[new], scores[new]
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[kept], ids[kept], scores[kept]


class Best:
    """The ``k`` best entries of each query that a task has seen so far, ties to smaller ids.

    What can't be among them any more isn't kept, so a task gives ``k`` rows a query however many
    lists it meets. ``full`` says when the queries are so many that a task should give them out.
    """

    def __init__(self, k: int, most_queries: int = 20_000, most_rows: int = 500_000) -> None:
        self.k, self.most_queries, self.most_rows = k, most_queries, most_rows
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.names, self.floors = np.zeros(0, np.int64), np.zeros(0)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def places(self, queries: np.ndarray) -> np.ndarray:
        at = np.array([self.place.setdefault(q, len(self.place)) for q in queries.tolist()], np.int64)
        if len(self.place) > len(self.names):
            more = len(self.place) - len(self.names)
            self.names = np.fromiter(self.place, np.int64, len(self.place))
            self.floors = np.concatenate([self.floors, np.full(more, -np.inf)])
        return at

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.hold(*best_rows(at, ids, scores, self.k))
        if self.rows > self.most_rows:
            self.shrink()

    def hold(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        last = np.arange(len(at)) - np.searchsorted(at, at) == self.k - 1
        self.floors[at[last]] = np.maximum(self.floors[at[last]], scores[last])
        self.held.append((at, ids, scores))
        self.rows += len(at)

    def shrink(self) -> None:
        held, self.held, self.rows = self.held, [], 0
        self.hold(*best_rows(*(np.concatenate(c) for c in zip(*held, strict=True)), self.k))

    @property
    def full(self) -> bool:
        return len(self.place) > self.most_queries

    def give(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        self.shrink()
        at, ids, scores = self.held[0]
        out = self.names[at], ids, scores
        self.clear()
        return out


def top_mask(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row, where its ``k`` highest scores are, all ties of the last included."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    last = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return scores >= last[:, None]


def batches_of(rows: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    for columns in rows:
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
