import math
import random

import numpy as np
import pytest

from commitlens.llm.postings import Options, fit, nearest
from commitlens.llm.topk import top_k
from commitlens.llm.vectors import Best

VECTORS = "vec_id long, embedding array<double>, label int, score string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x") for i, v in rows], VECTORS)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, queries, k, product):
    pool = sorted({(i, tuple(v)) for i, v in rows if i is not None and usable(v)})
    out = {}
    for q, v in pool:
        if q in queries:
            scored = sorted((-product(v, w), i) for i, w in pool if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def integers(v, w):
    return sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(v, w, strict=False))


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def corpus(n=400, dim=8, seed=1):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, list(rows[0][1])) for i in range(120)]  # a large group of copies
    rows += [(n + 200, None), (n + 210, []), (n + 220, [1.0, None] + [0.0] * 6), (n + 230, [math.nan] * 8), (n + 240, [math.inf] + [0.0] * 7), (None, [1.0] * 8)]
    rows += [(7, rows[7][1]), (n + 250, [0.5, -0.5]), (n + 260, [-0.0] * 8)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [1, 10])
def test_top_k_equals_brute_force(spark, k):
    rows = corpus()
    vectors = table(spark, rows)
    got = results(top_k(vectors, vectors.filter("vec_id % 10 = 0"), k=k))
    want = brute(rows, {i for i, _ in rows if i is not None and i % 10 == 0}, k, integers)
    assert got == want


def test_top_k_with_negative_scores_few_rows_and_large_components(spark):
    rows = [(i, [-1.0 - i, 2.0]) for i in range(3)] + [(3, [-5.0, -100.0]), (4, [1e9, 1.0])]
    vectors = table(spark, rows)
    assert results(top_k(vectors, vectors, k=10)) == brute(rows, set(range(5)), 10, integers)
    assert top_k(vectors, vectors.limit(0)).collect() == []
    assert top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_nearest_finds_all_of_few(spark):
    rows = corpus(40)
    rows = [(i, v) for i, v in rows if v is None or any(v)]
    vectors = table(spark, rows)
    got = results(nearest(vectors, vectors.filter("vec_id % 5 = 0"), k=500))
    want = brute(rows, {i for i, _ in rows if i is not None and i % 5 == 0}, 500, lambda a, b: sum(x * y for x, y in zip(a, b, strict=False)))
    assert {q: sorted(i for i, _ in r) for q, r in got.items()} == {q: sorted(i for i, _ in r) for q, r in want.items()}


def test_recall_and_exact_scores(spark):
    rows = [(i, [x * (1 + i % 3) for x in v]) for i, v in corpus(3000, 16, 3) if i is not None and usable(v) and any(v) and len(v) == 16]
    vectors = table(spark, rows)
    queries = {i for i, _ in rows if i % 20 == 0}
    got = results(nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20, options=Options(list_rows=100)))
    want = brute(rows, queries, 20, lambda a, b: float(np.dot(a, b)))
    by_id = dict(rows)
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and len({i for i, _ in found}) == 20 and q not in {i for i, _ in found}
        hits += len({i for i, _ in found} & {i for i, _ in want[q]})
        assert all(s == pytest.approx(np.dot(by_id[q], by_id[i]), rel=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert set(got) == queries and hits / (20 * len(queries)) > 0.9


def test_empty_tables(spark):
    vectors = table(spark, [(1, None), (2, [0.0, 0.0])])
    assert nearest(vectors, vectors).collect() == []
    assert nearest(vectors.limit(0), vectors.limit(0)).collect() == []


def test_lists_are_balanced_and_the_graph_reaches_all():
    rng = np.random.default_rng(0)
    sample = rng.normal(size=(4000, 8)) * np.where(np.arange(4000) < 3000, 0.1, 1)[:, None]
    index = fit(sample, 4000, float((sample**2).sum(1).max()), Options(list_rows=100))
    points = index.widened(sample, query=False)
    near, far = index.search(points, len(index.centers))
    exact = np.linalg.norm(points[:, None] - index.centers[None], axis=2)
    assert np.allclose(far, np.sort(exact, axis=1), atol=1e-6)
    first, _ = index.search(points, 8)
    assert (first[:, 0] == exact.argmin(1)).mean() > 0.95
    assert np.bincount(first[:, 0], minlength=len(index.centers)).max() < 300


def test_best_entries_of_a_task():
    rng = np.random.default_rng(5)
    best = Best(3, most_queries=10, most_rows=40)
    want, got = {}, {}
    for _ in range(60):
        names = rng.integers(0, 9, 5)
        at = best.places(np.unique(names))
        row = rng.integers(0, len(at), 30)
        ids, scores = rng.integers(0, 50, 30), rng.integers(0, 20, 30).astype(float)
        for r, i, s in zip(row, ids, scores, strict=True):
            entries = want.setdefault(int(np.unique(names)[r]), {})
            entries[int(i)] = max(s, entries.get(int(i), -1))
        keep = scores >= best.floors[at[row]]
        best.add(at[row][keep], ids[keep], scores[keep])
    for q, i, s in zip(*best.give(), strict=True):
        got.setdefault(int(q), []).append((int(i), s))
    assert got == {q: sorted(e.items(), key=lambda x: (-x[1], x[0]))[:3] for q, e in want.items()}
    assert not best.held and len(best.give()[0]) == 0
