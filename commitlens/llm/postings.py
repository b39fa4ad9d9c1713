"""Approximate nearest neighbours by inner product over balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from commitlens.llm.common import modest_batches, partitions, stored
from commitlens.llm.vectors import QUERY_BLOCK, Best, batches_of, best_of, classes, matrix, usable

POINTS = 256  # points that walk the graph together
STEP_BYTES = 32 << 20  # vectors met in a step of their walk
ENTRIES = 1 << 19  # entries of queries that a task takes up at once
OUT_BYTES = 8 << 20  # vectors of a batch that goes back to Spark


@dataclass(frozen=True)
class Options:
    """``sample_rows`` bounds what centroids are fitted on, twice ``most_lists`` their number.

    ``group_bytes`` bounds the vectors of lists that a task holds at once.
    """

    sample_rows: int = 20_000
    most_lists: int = 4096
    list_rows: int = 200
    replicas: int = 4
    boundary: float = 1.25  # a vector goes to lists up to so many times as far as its nearest
    ratio: float = 1.14  # a query to lists up to so many times as far as its nearest
    degree: int = 16
    block_rows: int = 2048
    rounds: int = 10
    group_bytes: int = 32 << 20


@dataclass(frozen=True)
class Centroids:
    """Centres of the lists, a graph that links each to near ones, and where searches start.

    ``radius2`` is the greatest squared length of a vector. With a component that brings each vector
    to that length, and 0 in queries, the nearest vector has the largest inner product.
    """

    centers: np.ndarray
    links: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    radius2: float

    def widened(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(vectors), self.centers.shape[1]))
        width = min(vectors.shape[1], out.shape[1] - 1)
        out[:, :width] = vectors[:, :width]
        if query:
            lengths = np.linalg.norm(out, axis=1, keepdims=True)
            out *= np.sqrt(self.radius2) / np.where(lengths > 0, lengths, 1)
        else:
            out[:, -1] = np.sqrt(np.maximum(self.radius2 - (vectors**2).sum(axis=1), 0))
        return out

    def search(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centres found for each point, nearest first, and their distances.

        All points walk the graph together: each round, every point opens the nearest centres that it has
        seen and not opened, as long as they are among its ``width`` nearest. Only these are held and compared with
        what the round adds. Links are seen in steps: all of a round would take many times the memory of the centres.
        """
        n, many, degree = len(points), len(self.centers), self.links.shape[1]
        width = min(width, many)
        squares, norms = (points**2).sum(axis=1), (self.centers**2).sum(axis=1)
        seen = np.full((n, many), -1, np.int32)
        step = max(1, STEP_BYTES // (16 * degree * points.shape[1]))

        def see(row: np.ndarray, column: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, ...]:
            new = seen[row, column] < 0
            row, column = row[new], column[new]
            nth = np.arange(len(row), dtype=np.int32)
            seen[row, column] = nth
            once = seen[row, column] == nth
            row, column = row[once], column[once]
            d = squares[row] + norms[column] - 2 * np.einsum("ij,ij->i", points[row], self.centers[column])
            d = np.sqrt(np.maximum(d, 0))
            near = d < worst[row]
            return row[near], column[near], d[near]

        seen[:, self.starts] = 0
        best = np.tile(self.starts, (n, 1))
        far = squares[:, None] + norms[self.starts] - 2 * np.einsum("ij,kj->ik", points, self.centers[self.starts])
        far, opened = np.sqrt(np.maximum(far, 0)), np.zeros(far.shape, bool)
        while True:
            if far.shape[1] > width:
                nearest = np.argpartition(far, width - 1, axis=1)[:, :width]
                best, far, opened = (np.take_along_axis(x, nearest, axis=1) for x in (best, far, opened))
            row, at = np.nonzero(np.isfinite(far) & ~opened)
            if not len(row):
                break
            opened[row, at] = True
            column, held = best[row, at], far.shape[1]
            worst = far.max(axis=1) if held == width else np.full(n, np.inf)
            parts = [slice(first, first + step) for first in range(0, len(row), step)]
            found = [see(np.repeat(row[part], degree), self.links[column[part]].ravel(), worst) for part in parts]
            row, column, d = (np.concatenate(c) for c in zip(*found, strict=True))
            # Rows come in order, so an entry's place is its distance from the first of its point.
            more = np.bincount(row, minlength=n)
            at = held + np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more)
            room = ((0, 0), (0, int(more.max())))
            best, far, opened = np.pad(best, room), np.pad(far, room, constant_values=np.inf), np.pad(opened, room)
            best[row, at], far[row, at] = column, d
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(best, order, axis=1), np.take_along_axis(far, order, axis=1)


def clustered(points: np.ndarray, parts: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Which of ``parts`` clusters each point belongs to, by Lloyd's method."""
    centers = points[rng.choice(len(points), parts, replace=False)]
    own = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        own = np.argmin((centers**2).sum(axis=1) - 2 * points @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        sizes = np.bincount(own, minlength=parts)[:, None]
        centers = np.where(sizes > 0, sums / np.maximum(sizes, 1), centers)
    return own


def fit(sample: np.ndarray, count: int, radius2: float, options: Options) -> Centroids:
    """Balanced centres of ``count`` vectors from a sample of them, and their graph.

    The sample is clustered top down: what holds more than its share of a list is split again, so dense
    regions get as many centres as they need. Equal vectors can't be split and stay one centre.
    """
    lists = int(np.clip(-(-count // options.list_rows), 1, min(options.most_lists, len(sample))))
    rng = np.random.default_rng(7)
    points = np.hstack([sample, np.sqrt(np.maximum(radius2 - (sample**2).sum(axis=1), 0))[:, None]])
    share = len(points) / lists
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        parts = min(8, int(np.ceil(len(rows) / share)))
        own = clustered(points[rows], parts, options.rounds, rng) if len(rows) > 1.3 * share and parts > 1 else np.zeros(len(rows), np.int64)
        if own.min() == own.max():
            leaves.append(points[rows].mean(axis=0))
        else:
            todo += [rows[own == p] for p in np.unique(own)]
    centers = np.array(leaves)
    lists = len(centers)
    degree = min(options.degree, lists - 1)
    squares = (centers**2).sum(axis=1)
    links = np.zeros((lists, max(degree, 1)), np.int64)
    for first in range(0, lists, 512):
        part = np.arange(first, min(first + 512, lists))
        d = squares[None, :] - 2 * centers[part] @ centers.T
        d[np.arange(len(part)), part] = np.inf
        if degree:
            links[part] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
    # One start for each part of the graph that the others don't reach.
    reached, starts = np.zeros(lists, bool), []
    while not reached.all():
        starts.append(int(np.argmin(reached)))
        front = np.array(starts[-1:])
        while len(front):
            reached[front] = True
            front = np.unique(links[front])
            front = front[~reached[front]]
    return Centroids(centers, links, np.array(starts), np.zeros(lists, np.int64), radius2)


def assigned(index: Centroids, vectors: np.ndarray, options: Options) -> np.ndarray:
    """Whether each vector goes to each of its nearest lists: ids of lists, -1 for none.

    Besides its nearest list, a vector at a boundary goes to those that are nearly as near, nearest first.
    """
    points = index.widened(vectors, query=False)
    near, far = index.search(points, 4 * options.replicas)
    chosen = np.full((len(points), options.replicas), -1)
    chosen[:, 0] = near[:, 0]
    many = np.ones(len(points), np.int64)
    for k in range(1, near.shape[1]):
        open_ = (far[:, k] <= options.boundary * far[:, 0]) & (many < options.replicas)
        row = np.nonzero(open_)[0]
        chosen[row, many[row]] = near[row, k]
        many[row] += 1
    return chosen


def selected(index: Centroids, queries: np.ndarray, k: int, options: Options) -> list[np.ndarray]:
    """The lists that each query searches: those within ``ratio`` of the nearest, and enough to find ``k``."""
    points = index.widened(queries, query=True)
    width = 64
    while True:
        near, far = index.search(points, width)
        # Lists before this one hold fewer rows than k vectors in all their replicas might take.
        before = np.cumsum(index.sizes[near], axis=1) - index.sizes[near]
        wanted = (far <= options.ratio * far[:, :1]) | (before < (k + 1) * options.replicas)
        if width >= len(index.centers) or not wanted[:, -1].any():
            return [row[keep] for row, keep in zip(near, wanted, strict=True)]
        width *= 4


def packed(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each list the first group that holds it, and in how many it lies. Groups have about ``most`` rows or fewer.

    Lists that follow each other come from one cluster and share a group, so that a query whose lists are
    near each other goes to few groups. A list of more than ``most`` rows is cut into groups of its own.
    """
    parts = np.maximum(-(-sizes // most), 1)
    first, groups, room = np.zeros(len(sizes), np.int64), 0, 0
    for i, (rows, many) in enumerate(zip(sizes.tolist(), parts.tolist(), strict=True)):
        if many > 1 or rows > room or not groups:
            first[i], groups, room = groups, groups + many, most if many == 1 else 0
        else:
            first[i] = groups - 1
        room -= rows if many == 1 else 0
    return first, parts


class Shelf:
    """A group of lists in a task: the vectors by list and the ids of each."""

    def __init__(self, group: int) -> None:
        self.group = group
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.spans: dict[int, tuple[int, int, int]] = {}

    def add(self, lists: pa.Array, vectors: pa.ListArray, ids: pa.ListArray) -> None:
        """Takes rows in the order of their lists."""
        held = np.float32 if vectors.type.value_type == pa.float32() else np.float64
        self.parts.append((np.asarray(lists), matrix(vectors, held), np.diff(np.asarray(ids.offsets)), np.asarray(ids.flatten())))

    def close(self) -> None:
        """Makes one matrix of what was taken."""
        if not self.parts:
            return
        lists, vectors, many, ids = zip(*self.parts, strict=True)
        self.parts = []
        self.many, self.ids = np.concatenate(many), np.concatenate(ids)
        self.first = np.cumsum(self.many) - self.many
        self.vectors = np.zeros((len(self.many), max(v.shape[1] for v in vectors)), vectors[0].dtype)
        done = 0
        for v in vectors:
            self.vectors[done : done + len(v), : v.shape[1]] = v
            done += len(v)
        lists = np.concatenate(lists)
        names, begin = np.unique(lists, return_index=True)
        # An id may have several vectors; in how many of a list's it occurs at most.
        owners = np.repeat(lists, self.many)
        order = np.lexsort((self.ids, owners))
        same = np.diff(owners[order], prepend=-1).astype(bool) | np.diff(self.ids[order], prepend=0).astype(bool)
        runs = np.flatnonzero(same)
        times = np.maximum.reduceat(np.diff(np.append(runs, len(order))), np.unique(owners[order][runs], return_index=True)[1])
        self.spans = {n: (a, b, t) for n, (a, b), t in zip(names.tolist(), pairwise([*begin.tolist(), done]), times.tolist(), strict=True)}

    def search(
        self, queries: np.ndarray, row: np.ndarray, lists: np.ndarray, floors: np.ndarray, k: int, size: int
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, id and score of all that may be among the ``k`` best; ``row`` of ``queries`` searches ``lists``.

        ``floors`` are scores below which nothing can be among a query's ``k`` best. They are raised
        here, and may be raised by the caller between parts.
        """
        order = np.argsort(lists, kind="stable")
        row, lists = row[order], lists[order]
        names, begin = np.unique(lists, return_index=True)
        held, waiting = [], 0
        for name, own in zip(names.tolist(), np.split(row, begin[1:]), strict=True):
            low, high, times = self.spans.get(name, (0, 0, 1))
            # A list holds no vector twice. So many ids of its best vectors are k ids besides the query's own.
            enough = (k + 1) * times
            for at in range(low, high, size):
                width = min(queries.shape[1], self.vectors.shape[1])
                scores = queries[own, :width] @ self.vectors[at : min(at + size, high), :width].T.astype(np.float64)
                least = floors[own]
                hit = scores >= least[:, None]
                weights = self.many[at : min(at + size, high)]
                found = hit.astype(np.float32) @ weights.astype(np.float32)
                crowded = np.nonzero(found > np.where(np.isinf(least), enough, 4 * enough))[0]
                if len(crowded):
                    some = scores[crowded]
                    keep = min(enough, some.shape[1])
                    top = np.argpartition(some, some.shape[1] - keep, axis=1)[:, some.shape[1] - keep :]
                    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(some, top, axis=1), axis=1), axis=1)
                    last = (np.cumsum(weights[top], axis=1) >= enough).argmax(axis=1)
                    least[crowded] = some[np.arange(len(some)), top[np.arange(len(some)), last]]
                    hit[crowded] = some >= least[crowded, None]
                    floors[own] = least
                at_row, column = np.nonzero(hit)
                held.append((own[at_row], column + at, scores[at_row, column]))
                waiting += len(at_row)
                if waiting > ENTRIES:
                    yield from self.members(held, floors)
                    held, waiting = [], 0
        yield from self.members(held, floors)

    def members(self, held: list[tuple[np.ndarray, ...]], floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, id and score for every id of the vectors found, about ``ENTRIES`` at once."""
        if not held:
            return
        row, column, scores = (np.concatenate(c) for c in zip(*held, strict=True))
        kept = scores >= floors[row]
        row, column, scores = row[kept], column[kept], scores[kept]
        cuts = np.flatnonzero(np.diff(np.cumsum(self.many[column]) // ENTRIES)) + 1
        for r, c, s in zip(*(np.split(x, cuts) for x in (row, column, scores)), strict=True):
            each = self.many[c]
            nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            yield np.repeat(r, each), self.ids[np.repeat(self.first[c], each) + nth], np.repeat(s, each)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    options: Options = Options(),  # noqa: B008
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for each query, by inner product.

    Every vector is indexed: the centres of the lists are fitted on at most ``sample_rows`` vectors,
    taken by hash, and each vector goes to up to ``replicas`` lists. Lists lie in groups of at most
    ``group_bytes``; a longer list is cut, so no list is too long for a task. A query searches the lists
    that the distance ratio selects, and goes once to each group that holds some of them. A task holds
    one group, ``block_rows`` of whose vectors meet a block of queries at once. Scores are inner products of
    the original vectors in double precision. A query doesn't find rows with its own id; if there are at
    most ``k`` others, it finds all.

    Equal vectors are one class with its ``k + 1`` smallest ids, so copies fill no list. Vectors that are
    null, empty, zero or hold null or non-finite components, and null ids, take no part; components
    beyond the shorter vector's end count as 0. Rows that are wholly equal count once. An empty
    table gives an empty result. Centres and graph, at most ``2 * most_lists`` rows, go to every task.
    """
    spark = vectors.sparkSession
    modest_batches(spark)
    narrow = all(df.schema[vector_col].dataType == ArrayType(FloatType(), df.schema[vector_col].dataType.containsNull) for df in (vectors, queries))
    kind = "array<float>" if narrow else "array<double>"

    def clean(rows: DataFrame) -> DataFrame:
        vector = F.col(vector_col)
        rows = rows.filter(usable(vector) & F.exists(vector, lambda x: x != 0) & F.col(id_col).isNotNull())
        return rows.select(F.col(id_col).cast("long").alias("id"), vector.cast(kind).alias("vector"))

    held = stored(classes(clean(vectors), k + 1), "classes")
    asked = stored(clean(queries).distinct(), "queries")
    exact = F.col("vector").cast("array<double>")
    square = F.aggregate(exact, F.lit(0.0), lambda a, x: a + x * x)
    count, radius2, width = held.agg(F.count("*"), F.max(square), F.max(F.size("vector"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not count:
        return empty
    taken = held.orderBy(F.xxhash64(exact)).limit(options.sample_rows).select("vector").toArrow()
    sample = matrix(taken.column(0).combine_chunks())
    sample = np.hstack([sample, np.zeros((len(sample), width - sample.shape[1]))])
    index = fit(sample, count, radius2, options)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, POINTS):
                part = batch.slice(first, POINTS)
                lists = assigned(index, matrix(part.column(0)), options)
                row, at = np.nonzero(lists >= 0)
                columns = [pa.array(lists[row, at]), *[c.take(pa.array(row)) for c in part.columns]]
                yield pa.RecordBatch.from_arrays(columns, ["list", "vector", "ids"])

    postings = stored(held.select("vector", "ids").mapInArrow(assign, f"list long, vector {kind}, ids array<long>"), "postings")
    sizes = {r["list"]: r["n"] for r in postings.groupBy("list").agg(F.count("*").alias("n")).collect()}
    index.sizes[list(sizes)] = list(sizes.values())
    # Two groups for each task, or more where a task couldn't hold them: queries are sent once to each.
    even = max(-(-sum(sizes.values()) // (2 * partitions(spark))), options.block_rows)
    firsts, parts = packed(index.sizes, max(1, min(even, options.group_bytes // (8 * width))))
    places = spark.createDataFrame([(i, *p) for i, p in enumerate(zip(firsts.tolist(), parts.tolist(), strict=True))], "list long, first long, parts long")
    group = F.col("first") + F.pmod(F.xxhash64("vector"), F.col("parts"))
    lists = postings.join(F.broadcast(places), "list").select(group.alias("group"), F.lit(0).alias("kind"), F.col("list").alias("one"), "vector", F.col("ids").alias("many"))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, OUT_BYTES // (8 * width))
        for batch in batches:
            for first in range(0, batch.num_rows, POINTS):
                part = batch.slice(first, POINTS)
                found = selected(index, matrix(part.column(1)), k, options)
                row, lists = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)
                # A list that was cut lies in several groups.
                each = parts[lists]
                row, lists, nth = np.repeat(row, each), np.repeat(lists, each), np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                group = firsts[lists] + nth
                order = np.lexsort((group, row))
                row, lists, group = row[order], lists[order], group[order]
                begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (group[1:] != group[:-1])]))
                ends = np.append(begin, len(row))
                for at in range(0, len(begin), size):
                    some, offsets = begin[at : at + size], ends[at : at + size + 1]
                    asked_lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(lists[offsets[0] : offsets[-1]]))
                    columns = [pa.array(group[some]), pa.array(np.ones(len(some), np.int32)), *[c.take(pa.array(row[some])) for c in part.columns], asked_lists]
                    yield pa.RecordBatch.from_arrays(columns, ["group", "kind", "one", "vector", "many"])

    # Queries are few and searches long: they are dealt out anew.
    probes = asked.repartition(partitions(spark), "id").mapInArrow(select, f"group long, kind int, one long, vector {kind}, many array<long>")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Of each group come the rows of its lists, then the queries."""
        best, shelf = Best(k), Shelf(-1)
        for batch in batches:
            groups, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            ends = np.flatnonzero((groups[1:] != groups[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for low, high in pairwise([0, *ends.tolist(), batch.num_rows] if batch.num_rows else []):
                if shelf.group != groups[low]:
                    shelf = Shelf(groups[low])
                if kinds[low] == 0:
                    shelf.add(*batch.slice(low, high - low).columns[2:])
                    continue
                shelf.close()
                for first in range(low, high, QUERY_BLOCK):
                    names, queries, asked_lists = batch.slice(first, min(QUERY_BLOCK, high - first)).columns[2:]
                    names = np.asarray(names)
                    at = best.places(names)
                    floors = best.floors[at]
                    row = np.repeat(np.arange(len(names)), np.diff(np.asarray(asked_lists.offsets)))
                    for row, found, scores in shelf.search(matrix(queries), row, np.asarray(asked_lists.flatten()), floors, k, options.block_rows):
                        other = found != names[row]
                        best.add(at[row[other]], found[other], scores[other])
                        np.maximum(floors, best.floors[at], out=floors)
                    np.maximum.at(best.floors, at, floors)
                    if best.full:
                        yield best.give()
        yield best.give()

    met = lists.unionAll(probes).repartition(partitions(spark), "group").sortWithinPartitions("group", "kind", "one")
    found = met.mapInArrow(lambda b: batches_of(score(b), ["query_id", "vec_id", "score"]), "query_id long, vec_id long, score double")
    # A vector in several lists of a query is found in each.
    return best_of(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
