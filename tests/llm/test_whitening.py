import math
import random

import numpy as np
import pytest

from commitlens.llm.whitening import above, leading, whiten

VECTORS = "vec_id long, embedding array<double>, n string, whitened string, deviation string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], VECTORS).repartition(parts)


def symmetric(values, seed=3):
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    out = (turn * np.array(values)) @ turn.T
    return (out + out.T) / 2


CASES = {
    "apart": symmetric([9.0, 7.0, 4.0, 1.0, 0.5, 0.25, 0.1, 0.05, 0.01]),
    "signs": symmetric([5.0, -5.0, 3.0, -2.0, 0.0, 1.0]),
    "zero diagonal": np.array([[0.0, 1.0, 0.0], [1.0, 0.0, 2.0], [0.0, 2.0, 0.0]]),
    "nearly equal": symmetric([1 + i * 1e-13 for i in range(5)] + [0.5] * 5 + [0.1] * 20),
    "equal": 7.0 * np.eye(12),
    "rank three": symmetric([3.0, 2.0, 1.0] + [0.0] * 9),
    "nothing": np.zeros((4, 4)),
    "one": np.array([[2.5]]),
    "many": np.cov(np.random.default_rng(0).standard_normal((64, 700)), bias=True),
    "close": symmetric(np.linspace(1.0, 1.0001, 40)),
}


@pytest.mark.parametrize("name", CASES)
def test_counts_equal_the_number_of_eigenvalues_above(name):
    values = np.linalg.eigvalsh(CASES[name])
    for shift in np.random.default_rng(5).uniform(values.min() - 1, values.max() + 1, 40):
        if np.abs(values - shift).min() > 1e-9:
            assert above(CASES[name], shift) == (values > shift).sum()


@pytest.mark.parametrize("name", CASES)
def test_leading_eigenvectors_to_double_precision(name):
    matrix = CASES[name]
    values = np.linalg.eigvalsh(matrix)[::-1]
    found = leading(matrix, min(8, len(matrix)))
    scale = max(np.abs(values).max(), 1e-300)
    vectors = np.array([v for _, v in found])
    assert np.abs([e for e, _ in found] - values[: len(found)]).max() <= 1e-12 * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(found))).max() <= 1e-13
    assert max(np.linalg.norm(matrix @ v - e * v) for e, v in found) <= 1e-12 * scale


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, components):
    """The contract with Python's whole numbers and a library eigensolver."""
    kept = [(i, v) for i, v in rows if usable(v)]
    width = max(len(v) for _, v in kept)
    x = [[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (width - len(v)) for _, v in kept]
    n = len(x)
    s = [sum(column) for column in zip(*x, strict=True)]
    off = [[n * c - t for c, t in zip(row, s, strict=True)] for row in x]
    centred = np.array([[d / n for d in row] for row in off])
    spread = centred.T @ centred / n
    values, vectors = np.linalg.eigh(spread)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    whitened = centred @ vectors / np.sqrt(values)
    explained = values / np.trace(spread)
    return n, [(i, sum(d * d for d in row), w) for (i, _), row, w in zip(kept, off, whitened, strict=True)], explained


def corpus(n=300, width=12, seed=2, scale=1.0):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1 + j / 3) * scale for j in range(width)]) for i in range(n)]
    rows += [(n + i, list(rows[0][1])) for i in range(40)]  # copies count
    rows += [(5, rows[5][1]), (None, [0.5] * width), (n + 50, [0.25] * (width - 3)), (n + 51, [])]
    rows += [(n + 60, None), (n + 61, [None] + [1.0] * (width - 1)), (n + 62, [math.nan] * width), (n + 63, [-math.inf] * width)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_whitening_equals_brute_force(spark, scale):
    rows = corpus(scale=scale)
    n, want, explained = brute(rows, 8)
    got = whiten(table(spark, rows)).collect()
    assert len(got) == len(want) == n
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    got, want = sorted(((r.vec_id, int(r.deviation), r.whitened) for r in got), key=order), sorted(want, key=order)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    mine, theirs = np.array([g[2] for g in got]), np.array([w[2] for w in want])
    assert np.abs(np.abs(mine) - np.abs(theirs)).max() < 1e-9
    signs = np.sign((mine * theirs).sum(axis=0))  # one sign a component, the same for all rows
    assert np.abs(mine - theirs * signs).max() < 1e-9
    row = whiten(table(spark, rows)).first()
    assert row.n == n and np.allclose(row.explained, explained, rtol=1e-9) and row.identity_error < 1e-9


def test_spread_does_not_change_the_result(spark):
    rows = corpus()
    one, many = (sorted(whiten(table(spark, rows, p)).collect(), key=lambda r: (r.vec_id or 0, r.deviation)) for p in (1, 7))
    assert [(r.vec_id, r.deviation, r.n, r.explained) for r in one] == [(r.vec_id, r.deviation, r.n, r.explained) for r in many]
    assert np.abs(np.array([r.whitened for r in one]) - np.array([r.whitened for r in many])).max() < 1e-13


def test_without_variance(spark):
    same = whiten(table(spark, [(i, [1.0, 2.0, 3.0]) for i in range(4)])).collect()
    assert {(int(r.deviation), tuple(r.whitened), tuple(r.explained), r.identity_error) for r in same} == {(0, (None,) * 3, (None,) * 3, None)}
    line = whiten(table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] and r.identity_error < 1e-9 for r in line)
    assert whiten(table(spark, [(1, [4.0])])).collect()[0].whitened == [None]
    assert whiten(table(spark, [(1, [])])).collect()[0].whitened == []


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None), (2, [None])]):
        found = whiten(table(spark, rows))
        assert found.collect() == [] and found.columns == ["vec_id", "deviation", "whitened", "n", "explained", "identity_error"]


def test_too_large_for_whole_numbers(spark):
    with pytest.raises(Exception, match="too large"):
        whiten(table(spark, [(1, [1e30]), (2, [1.0])])).collect()
