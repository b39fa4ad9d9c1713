import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from commitlens.llm.postings import Options, Shelf, fit, nearest, packed
from commitlens.llm.vectors import Best


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_wide_searches_take_little_memory():
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(1600, 64))
    index = fit(sample, 1600, float((sample**2).sum(1).max()), Options(list_rows=2, rounds=2))
    assert len(index.centers) > 600
    points = index.widened(sample[:256], query=True)
    assert peak_mb(lambda: index.search(points, 512)) < 150


def test_groups_hold_lists_in_order_and_cut_long_ones():
    sizes = np.array([3, 4, 0, 5, 25, 2, 9, 1])
    first, parts = packed(sizes, 10)
    assert parts.tolist() == [1, 1, 1, 1, 3, 1, 1, 1]
    assert first.tolist() == [0, 0, 0, 1, 2, 5, 6, 6]
    assert packed(np.array([0, 7]), 5)[0].tolist() == [0, 1]


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("group_bytes", [100, 4000, 32 << 20])
def test_lists_cut_into_groups_give_the_same(spark, kind, group_bytes):
    rng = np.random.default_rng(4)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(600, 6)))]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(300)]  # seven vectors that come many times
    rows += [(5, rows[9][1]), (2000, rows[0][1][:3])]  # an id with two vectors, a shorter vector
    rows += [(3000, [x + j / 64 for x in rows[15][1]]) for j in range(12)]  # one with many near a query
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    # All lists are searched, so results are those of brute force.
    options = Options(list_rows=20, ratio=100.0, block_rows=16, group_bytes=group_bytes)
    got = {}
    for r in nearest(vectors, vectors.filter("vec_id % 10 = 5"), k=4, options=options).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    width = max(len(v) for _, v in rows)
    table = np.array([v + [0.0] * (width - len(v)) for _, v in rows])
    ids = np.array([i for i, _ in rows])
    for query in {i for i, _ in rows if i % 10 == 5}:
        scores = (table[ids == query] @ table.T).max(axis=0)
        best = {}
        for i, s in zip(ids.tolist(), scores.tolist(), strict=True):
            best[i] = max(s, best.get(i, s))
        best.pop(query)
        want = sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4]
        found = [got[query][rank] for rank in range(1, 5)]
        assert [i for i, _ in found] == [i for i, _ in want]
        assert [s for _, s in found] == pytest.approx([s for _, s in want], rel=1e-12)


def test_entries_of_many_copies_are_taken_up_in_parts(monkeypatch):
    monkeypatch.setattr("commitlens.llm.postings.ENTRIES", 50)
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(40, 5))
    shelf = Shelf(0)
    for low, high in ((0, 25), (25, 40)):
        lists = pa.array(np.arange(low, high) // 10)
        ids = pa.array([[100 * i + j for j in range(6)] for i in range(low, high)], pa.list_(pa.int64()))
        shelf.add(lists, pa.array(vectors[low:high].tolist(), pa.list_(pa.float64())), ids)
    shelf.close()
    queries = rng.normal(size=(3, 5))
    best, floors = Best(5), np.full(3, -np.inf)
    at = best.places(np.array([-1, -2, -3]))
    row, lists = np.repeat(np.arange(3), 3), np.array([0, 1, 3, 1, 2, 3, 0, 2, 7])
    parts = list(shelf.search(queries, row, lists, floors, 5, 4))
    assert max(len(p[0]) for p in parts) <= 56
    for r, ids, scores in parts:
        best.add(at[r], ids, scores)
    got = {}
    for q, i, s in zip(*best.give(), strict=True):
        got.setdefault(int(q), []).append((int(i), s))
    for q, (query, mine) in enumerate(zip(queries, ([0, 1, 3], [1, 2, 3], [0, 2]), strict=True)):
        found = sorted((-float(query @ vectors[i]), 100 * i + j) for i in range(40) if i // 10 in mine for j in range(6))[:5]
        assert [i for i, _ in got[-1 - q]] == [i for _, i in found]
        assert [s for _, s in got[-1 - q]] == pytest.approx([-s for s, _ in found])
