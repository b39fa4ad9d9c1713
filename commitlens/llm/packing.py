"""Best-fit packing of pieces into sequences, in sweeps over runs of equal length."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.llm.common import modest_batches, stored

RANK_BITS = 48
BROADCAST_BYTES = 32 << 20
Placement = tuple[int, int, int, int, int]


def best_fit(counts: Mapping[int, int], capacity: int) -> list[Placement]:
    """Places ``counts[length]`` pieces of each length into sequences of ``capacity``.

    Pieces and gaps are sorted by size and taken as runs: pieces of one length differ only in their
    rank, sequences with gaps of one size only in their number. Sweep by sweep, longest first, a
    run of pieces goes to its successor, the smallest gap that holds one. Who gets which place is
    settled by rank: the first ranks take the lowest numbered sequences, as many pieces in each as
    fit, and the rest of the run goes to the next larger gap, at last to new sequences. Gaps
    are updated before the next sweep. That is best-fit decreasing, piece by piece.

    Returns ``(length, first rank, pieces, first sequence, offset)``: pieces of consecutive ranks lie
    in consecutive sequences. There are at most ``capacity`` lengths and sizes of gaps, whatever the
    number of pieces; gaps of one size that were left at different times are several runs, so
    there are a few placements for each length and size that meet (some thousands, by measurement).
    """
    placed: list[Placement] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    sizes: list[int] = []  # the gaps there are, ascending
    opened = 0

    def give(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(gap: int, first: int, many: int, each: int) -> None:
            """``each`` pieces into each of ``many`` sequences."""
            nonlocal rank, left
            for nth in range(each):
                placed.append((length, rank, many, first, capacity - gap + nth * length))  # noqa: B023
                rank += many
            left -= many * each
            give(gap - each * length, first, many)  # noqa: B023

        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                fit = capacity // length
                many, rest = divmod(left, fit)
                first, opened = opened, opened + many + (rest > 0)
                if many:
                    fill(capacity, first, many, fit)
                if rest:
                    fill(capacity, first + many, 1, rest)
                continue
            gap = sizes[at]
            first, there = gaps[gap].pop()
            fit = gap // length
            many, rest = min(there, left // fit), left % fit if left // fit < there else 0
            if many:
                fill(gap, first, many, fit)
            if rest:
                fill(gap, first + many, 1, rest)
            used = many + (rest > 0)
            if there > used:
                gaps[gap].append((first + used, there - used))
            if not gaps[gap]:
                del gaps[gap]
                sizes.remove(gap)
    return placed


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity``, without gaps.

    Each task counts the pieces of each length that it has; ranks among the pieces of a length follow from
    these counts by running sums over the tasks, so a length that a third of all pieces have needs no task
    of its own. The driver gets the number of pieces of each length, at most ``capacity`` numbers,
    and makes the sweeps (``best_fit``). Each row then finds its place by its rank.

    Rows whose length is null, below 1 or above ``capacity`` get a null sequence and offset. Equal
    rows are several pieces. Columns named ``sequence_id`` or ``offset`` are replaced. An empty
    table gives an empty result.
    """
    modest_batches(pieces.sparkSession)
    own = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    # The row travels as one column, so that its names can't clash with those used here.
    rows = pieces.select(F.struct(*own).alias("row"), F.col(length_col).cast("long").alias("size"))
    row_type = rows.schema["row"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's place among the rows of its length in this task."""
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            sizes = _sizes(batch.column(1), capacity)
            order = np.argsort(sizes, kind="stable")
            ordered = sizes[order]
            first = np.searchsorted(ordered, ordered)
            nth = np.empty(len(sizes), np.int64)
            nth[order] = seen[ordered] + np.arange(len(sizes)) - first
            seen += np.bincount(sizes, minlength=capacity + 1)
            columns = [batch.column(0), pa.array(sizes), pa.array(np.full(len(sizes), task)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "size", "task", "nth"])

    numbers = [T.StructField(c, T.LongType()) for c in ("size", "task", "nth")]
    table = stored(rows.mapInArrow(number, T.StructType([row_type, *numbers])), "pieces")
    counts = table.filter("size > 0").groupBy(F.col("size").alias("_size"), F.col("task").alias("_task")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("_size").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "counts")
    totals = {r["_size"]: r["n"] for r in counts.groupBy("_size").agg(F.sum("n").alias("n")).collect()}
    places = np.array(sorted(best_fit(totals, capacity)), np.int64).reshape(-1, 5)
    keys = (places[:, 0] << RANK_BITS) + places[:, 1]

    bases = counts.drop("n")
    if counts.count() * 32 <= BROADCAST_BYTES:
        bases = F.broadcast(bases)
    ranked = table.join(bases, (F.col("size") == F.col("_size")) & (F.col("task") == F.col("_task")), "left")
    ranked = ranked.select("row", "size", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, size, rank = batch.columns
            sizes, ranks = np.asarray(size), np.asarray(pc.fill_null(rank, 0))
            found = np.zeros((len(sizes), 5), np.int64)
            if len(keys):
                found = places[np.maximum(np.searchsorted(keys, (sizes << RANK_BITS) + ranks, side="right") - 1, 0)]
            nowhere = sizes == 0
            columns = [row, pa.array(found[:, 3] + ranks - found[:, 1], mask=nowhere), pa.array(found[:, 4], mask=nowhere)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "sequence_id", "offset"])

    out = T.StructType([row_type, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, out).select("row.*", "sequence_id", "offset")


def _sizes(column: pa.Array, capacity: int) -> np.ndarray:
    """Lengths as integers, 0 for those that fit nowhere."""
    sizes = np.asarray(pc.fill_null(column, 0))
    return np.where((sizes < 1) | (sizes > capacity), 0, sizes)
