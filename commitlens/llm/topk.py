"""Exact top-k search by inner product with a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import stored
from commitlens.llm.vectors import QUERY_BLOCK, batches_of, best_of, blocks, classes, matrix, same_width, top_mask, usable

LISTS = 4  # partial scores of a vector, each over a part of its components
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def partial_scores(queries: np.ndarray, vectors: np.ndarray, lists: int = LISTS) -> list[np.ndarray]:
    """Exact integer inner products over each part of the components, queries by vectors.

    Floating-point sums below 2**53 are exact and fast; beyond that Python's integers are used.
    """
    queries, vectors = same_width(queries, vectors)
    parts = np.array_split(np.arange(queries.shape[1]), lists)
    bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(queries.shape[1], 1)
    if bound >= EXACT:
        whole = [[[int(x) for x in row] for row in m] for m in (queries, vectors)]
        queries, vectors = (np.array(m, object).reshape(len(m), -1) for m in whole)
    return [queries[:, p] @ vectors[:, p].T for p in parts]


def quantised(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector``, its components as floor(scale * x); unusable vectors and null ids left out."""
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())

    def floor(x: Column) -> Column:
        # floor() gives longs; doubles that don't fit one are whole anyway.
        y = x.cast("double") * scale
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    whole = F.transform(F.col(vector_col), floor)
    return rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("vector"))


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: float = 1024.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` highest integer inner products.

    Components are floor(``scale`` * x). A query doesn't find rows with its own id; ties go to the
    smaller id; all are returned if there are fewer. ``queries`` is a stated set of rows like those
    of ``vectors``; blocks of queries meet blocks of vectors.

    A vector's score is the sum of ``LISTS`` partial scores, one for each part of the components.
    Phase 1: every block gives the best entries of its lists for each query, with their scores; the
    k-th best of them is a safe cutoff, as at least k vectors reach it. Phase 2: the cutoffs go to
    all blocks with their queries. A score can reach a cutoff only if one of its partial scores
    reaches an equal share of it, the uniform threshold; those entries are collected. Phase 3: their
    other partial scores are resolved exactly, and the best are ranked.

    Equal vectors are one class with its ``k + 1`` smallest ids. Vectors that are null, empty or hold
    null or non-finite components, and null ids, take no part; components beyond a vector's end
    count as 0. Rows that are wholly equal count once, rows with the same id and other vectors
    are candidates each. Scores beyond a long end at its limits.
    """
    held = stored(classes(quantised(vectors, scale, id_col, vector_col), k + 1), "classes")
    asked = stored(quantised(queries, scale, id_col, vector_col).distinct(), "queries")
    block_rows = stored(blocks(held, held.count(), "vector", "ids"), "vector-blocks")
    query_rows = blocks(asked, asked.count(), "vector", "id", size=QUERY_BLOCK)
    query_rows = stored(query_rows.select(F.col("vector").alias("query"), F.col("id").alias("query_id")), "query-blocks")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for q, qid, v, ids in zip(*batch.columns, strict=True):
                parts = partial_scores(matrix(q.values), matrix(v.values))
                names = np.asarray(qid.values)
                members = ids.as_py()
                total = sum(parts)
                # Of each list the best k + 1 entries: one of them may be the query itself.
                listed = np.logical_or.reduce([top_mask(p, k + 1) for p in parts])
                best = np.where(listed, total, -np.inf) if total.dtype != object else np.where(listed, total, -(10**400))
                for i, name in enumerate(names.tolist()):
                    at = np.nonzero(listed[i])[0]
                    at = at[np.argsort(-best[i, at], kind="stable")][: k + 1]
                    scores = [s for j in at for s in [best[i, j]] * sum(m != name for m in members[j])][:k]
                    yield np.full(len(scores), name, np.int64), _long(scores)

    pairs = query_rows.crossJoin(block_rows).select("query", "query_id", "vector", "ids")
    lists = pairs.mapInArrow(lambda b: batches_of(gather(b), ["query_id", "score"]), "query_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    cutoffs = lists.withColumn("place", place).filter(F.col("place") == k).select("query_id", F.col("score").alias("cutoff"))
    exploded = query_rows.select(F.explode(F.arrays_zip("query", "query_id")).alias("q")).select("q.query", "q.query_id")
    # A query without k entries has no cutoff: every vector counts.
    known = stored(exploded.join(cutoffs, "query_id", "left"), "cutoffs")
    known = known.withColumn("cutoff", F.coalesce("cutoff", F.lit(-LONG - 1)))
    with_cutoffs = stored(blocks(known, known.count(), "query", "query_id", "cutoff", size=QUERY_BLOCK).drop("block"), "cutoff-blocks")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for q, qid, cut, v, ids in zip(*batch.columns, strict=True):
                parts = partial_scores(matrix(q.values), matrix(v.values))
                names, cutoff = np.asarray(qid.values), np.asarray(cut.values)
                share = np.floor_divide(cutoff, LISTS)  # rounded down, as scores are integers
                members = ids.as_py()
                entries = np.logical_or.reduce([p >= share[:, None] for p in parts])
                row, column = np.nonzero(entries)
                total = sum(p[row, column] for p in parts)
                enough = np.asarray(total >= cutoff[row], bool)
                row, column, total = row[enough], column[enough], total[enough]
                order = np.lexsort((-total.astype(np.float64), row)) if len(row) else row
                row, column, total = row[order], column[order], total[order]
                out: tuple[list, list, list] = ([], [], [])
                for i in np.unique(row).tolist():
                    at = np.nonzero(row == i)[0]
                    name = int(names[i])
                    found = [(-int(total[j]), m) for j in at for m in members[column[j]] if m != name]
                    for score, member in sorted(found)[:k]:
                        out[0].append(name)
                        out[1].append(member)
                        out[2].append(-score)
                yield np.array(out[0], np.int64), np.array(out[1], np.int64), _long(out[2])

    pairs = with_cutoffs.crossJoin(block_rows).select("query", "query_id", "cutoff", "vector", "ids")
    found = pairs.mapInArrow(
        lambda b: batches_of(resolve(b), ["query_id", "vec_id", "score"]), "query_id long, vec_id long, score long"
    )
    return best_of(found, k)


def _long(scores: list) -> np.ndarray:
    return np.array([min(max(int(s), -LONG - 1), LONG) for s in scores], np.int64)
