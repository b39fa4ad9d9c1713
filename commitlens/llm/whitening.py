"""Whitening of embeddings along the leading components of their covariance, found by spectrum slicing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import stored
from commitlens.llm.vectors import matrix

OFFSET = 100_000
EXACT = 1 << 53  # whole numbers below it are exact as doubles
LONG = 1 << 63
EPS = float(np.finfo(float).eps)
PIVOT = (1 + math.sqrt(17)) / 8  # bounds the growth of a symmetric factorisation


def above(symmetric: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than ``shift``: the positive part of the inertia of LDLᵀ.

    By Sylvester's law the shifted matrix and D have as many positive eigenvalues. D has blocks of
    one and two rows, chosen so that entries don't grow.
    """
    a = symmetric - shift * np.eye(len(symmetric))
    positive, k, n = 0, 0, len(a)
    while k < n:
        below = np.abs(a[k + 1 :, k])
        largest = below.max(initial=0.0)
        two = False
        if abs(a[k, k]) < PIVOT * largest:
            r = k + 1 + int(below.argmax())
            column = np.abs(a[k:, r])
            column[r - k] = 0
            if abs(a[k, k]) * column.max() < PIVOT * largest * largest:
                two = abs(a[r, r]) < PIVOT * column.max()
                swap = [k + two, r]
                a[swap] = a[swap[::-1]]
                a[:, swap] = a[:, swap[::-1]]
        if two:
            block, rest = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            determinant = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            positive += 1 if determinant < 0 else 2 * int(block[0, 0] + block[1, 1] > 0)
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            pivot = a[k, k]
            positive += int(pivot > 0)
            if pivot:
                column = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(column, column / pivot)
            k += 1
    return positive


def _apart(vector: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in found:
            vector = vector - (other @ vector) * other
    return vector / np.linalg.norm(vector)


def _solved(symmetric: np.ndarray, shift: float, vector: np.ndarray, scale: float) -> np.ndarray:
    """``vector`` through the inverse of the shifted matrix, nudged where that is singular."""
    identity = np.eye(len(symmetric))
    for nudge in (0.0, EPS * scale, 64 * EPS * scale):
        try:
            out = np.linalg.solve(symmetric - (shift + nudge) * identity, vector)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all():
            return out / np.abs(out).max()
    return vector


def leading(symmetric: np.ndarray, count: int) -> list[tuple[float, np.ndarray]]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, with unit eigenvectors.

    For each number k, bisection by inertia counts isolates an interval with the k-th eigenvalue and no
    other. From an inverse iteration at its middle, Rayleigh quotients converge cubically; one that
    leaves the interval is dropped and the interval halved again. Counts on both sides of the value
    found then certify that it is the k-th. Eigenvalues that are equal in double precision can't
    be isolated: their intervals shrink to rounding error, and their vectors are made orthogonal.
    """
    n = len(symmetric)
    radii = np.abs(symmetric).sum(axis=1) - np.abs(np.diag(symmetric))
    lowest, highest = float((np.diag(symmetric) - radii).min()), float((np.diag(symmetric) + radii).max())
    scale = max(abs(lowest), abs(highest))
    start = np.random.default_rng(1).standard_normal((count, n))
    if not scale:
        return [(0.0, v) for v in np.eye(n)[:count]]
    slack = 4 * n * EPS * scale
    counts = {lowest - slack: n, highest + slack: 0}
    found: list[tuple[float, np.ndarray]] = []

    def counted(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(symmetric, shift)
        return counts[shift]

    for k in range(1, count + 1):
        a = max(s for s, c in counts.items() if c >= k)
        b = min(s for s, c in counts.items() if c < k and s > a)
        before = [v for _, v in found]
        while True:
            isolated = counted(a) == k and counted(b) == k - 1
            if isolated or b - a <= slack:
                value, vector = _refined(symmetric, a, b, start[k - 1], before, scale)
                converged = float(np.linalg.norm(symmetric @ vector - value * vector)) <= slack
                certified = converged and counted(value - slack) >= k and counted(value + slack) < k
                if certified or b - a <= slack:
                    break
            middle = (a + b) / 2
            if middle in (a, b):
                break
            a, b = (middle, b) if counted(middle) >= k else (a, middle)
        found.append((value, vector))
    return found


def _refined(
    symmetric: np.ndarray, a: float, b: float, start: np.ndarray, before: list[np.ndarray], scale: float
) -> tuple[float, np.ndarray]:
    vector = _apart(start, before)
    for _ in range(2):
        vector = _apart(_solved(symmetric, (a + b) / 2, vector, scale), before)
    best = (math.inf, (a + b) / 2, vector)
    for _ in range(30):
        value = float(vector @ symmetric @ vector)
        residual = float(np.linalg.norm(symmetric @ vector - value * vector))
        if residual >= best[0] or not a - EPS * scale <= value <= b + EPS * scale:
            break
        best = (residual, value, vector)
        vector = _apart(_solved(symmetric, value, vector, scale), before)
    return best[1], best[2]


def _whole(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """floor(1024 * x) of every component, whole numbers; missing components count as 0."""
    y = np.floor(matrix(vectors) * 1024.0)
    if np.abs(y).max(initial=0) >= LONG / 2:
        raise ArithmeticError("a component is too large for whole numbers of 64 bits")
    return np.pad(y.astype(np.int64), ((0, 0), (0, max(0, width - y.shape[1]))))


def _most(whole: np.ndarray) -> int:
    return max(abs(int(whole.min(initial=0))), abs(int(whole.max(initial=0))))


def _gram(whole: np.ndarray) -> np.ndarray:
    """Sums of products of all pairs of columns, exact: doubles below 2**53, else Python's integers."""
    if _most(whole) ** 2 * max(len(whole), 1) < EXACT:
        real = whole.astype(float)
        return (real.T @ real).astype(np.int64).astype(object)
    return whole.astype(object).T @ whole.astype(object)


def _totals(columns: dict[str, list], ints: list[str], exact: str) -> pa.RecordBatch:
    arrays = [pa.array(columns[c], pa.int32()) for c in ints]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([Decimal(int(v)) for v in columns[exact]], pa.decimal128(38, 0))], [*ints, exact])


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many rows ``vector`` has, and the exact sum of each of its components as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros(0, object)
        for batch in batches:
            y = _whole(batch.column(0))
            small = _most(y) * max(len(y), 1) < LONG
            total = np.pad(total, (0, max(0, y.shape[1] - len(total))), constant_values=0)
            total[: y.shape[1]] += (y if small else y.astype(object)).sum(axis=0)
            rows += len(y)
        if rows:
            yield _totals({"at": [-1, *range(len(total))], "total": [rows, *total]}, ["at"], "total")

    found = vectors.select("vector").mapInArrow(run, "at int, total decimal(38,0)")
    totals = {r["at"]: int(r["total"]) for r in found.groupBy("at").agg(F.sum("total").alias("total")).collect()}
    n = totals.pop(-1, 0)
    return n, [totals[i] + OFFSET * n for i in range(len(totals))]


def covariance(vectors: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance of the components, divisor ``n``, each entry rounded once.

    Components are centred by their rounded mean before they are multiplied, so products stay
    small and their sums are exact; what the rounding of the mean leaves is taken off exactly. So the
    result doesn't depend on how rows are spread. A task gives a row for each pair of components.
    """
    middle = [(2 * t + n) // (2 * n) for t in total]
    left = [t - n * m for t, m in zip(total, middle, strict=True)]
    width = len(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, centre = None, np.array(middle, np.int64) - OFFSET
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = _gram(_whole(batch.column(0).slice(first, 4096), width) - centre)
                gram = part if gram is None else gram + part
        if gram is not None:
            i, j = np.triu_indices(width)
            yield _totals({"i": i.tolist(), "j": j.tolist(), "total": gram[i, j].tolist()}, ["i", "j"], "total")

    found = vectors.select("vector").mapInArrow(run, "i int, j int, total decimal(38,0)")
    out = np.zeros((width, width))
    for r in found.groupBy("i", "j").agg(F.sum("total").alias("total")).toLocalIterator():
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = (n * int(r["total"]) - left[i] * left[j]) / (n * n)
    return out


def whiten(
    rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id``, ``deviation``, ``whitened``, ``n``, ``explained``, ``identity_error``: a row for each usable vector.

    A component c of a vector counts as the whole number x = floor(1024 * c) + 100000. ``whitened`` and
    ``explained`` are arrays by component of the covariance of x, largest eigenvalue first, at most
    ``components`` and the vectors' width: x less its mean, projected on the unit eigenvector and
    divided by the root of the eigenvalue; and the eigenvalue's share of the trace. ``deviation`` is
    the sum of (n * x - S)**2, S being the sums of x: exact, a decimal of 38 digits, or an error
    beyond them. ``identity_error`` is the largest absolute difference between the covariance
    of ``whitened`` over all rows and the identity.

    Vectors that are null or hold null or non-finite components take no part. Shorter ones, empty
    ones too, go on with 0. Repeated rows count as often as they occur, ids may be null, other columns
    are ignored. Along a component without variance (fewer distinct vectors than components) ``whitened``
    is null and ``identity_error`` leaves it out; without any variance ``explained`` and
    ``identity_error`` are null. An empty table gives an empty result. Components whose whole number doesn't
    fit 62 bits are an error. The driver holds the covariance, width times width numbers.
    """
    spark = rows.sparkSession
    vector = F.col(vector_col)
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vectors = rows.filter(vector.isNotNull() & fine).select(
        F.col(id_col).alias("vec_id"), F.transform(vector, lambda c: c.cast("double")).alias("vector")
    )
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    n, total = sums(vectors)
    if not n:
        kinds = "deviation decimal(38,0), whitened array<double>, n long, explained array<double>, identity_error double"
        return spark.createDataFrame([], f"vec_id {id_type}, {kinds}")
    width = len(total)
    spread = covariance(vectors, n, total)
    trace = float(np.trace(spread))
    pairs = leading(spread, min(components, width)) if width else []
    real = [value > 64 * width * EPS * trace for value, _ in pairs]
    scaled = np.array([v / math.sqrt(e) if r else 0 * v for (e, v), r in zip(pairs, real, strict=True)]).reshape(len(pairs), width).T

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.array(total, object) - OFFSET * n
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                y = _whole(part.column(1), width)
                # n * x - S, in 64 bits where that and the sum of its squares are sure to fit.
                most = n * _most(y) + max(map(abs, centre), default=0)
                fits = most < LONG
                off = y * n - centre.astype(np.int64) if fits else y.astype(object) * n - centre
                square = fits and _most(off) ** 2 * max(width, 1) < LONG
                exact = off if square else off.astype(object)
                deviation = pa.array([Decimal(int(d)) for d in (exact * exact).sum(axis=1)], pa.decimal128(38, 0))
                white = (off / n).astype(float) @ scaled
                missing = np.broadcast_to(~np.array(real, bool), white.shape).ravel()
                flat = pa.array(white.ravel(), mask=missing)
                lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * len(pairs), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), deviation, lists], ["vec_id", "deviation", "whitened"])

    found = stored(
        vectors.mapInArrow(project, f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>"), "whitened"
    )
    kept = [i for i, r in enumerate(real) if r]
    errors = [
        F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - float(i == j)) for i in kept for j in kept if i <= j
    ]
    error = found.select(F.greatest(*errors, F.lit(0.0))).first()[0] if errors else None
    shares = [F.lit(e / trace if trace else None).cast("double") for e, _ in pairs]
    return found.select(
        "vec_id", "deviation", "whitened", F.lit(n).cast("long").alias("n"),
        F.array(*shares).cast("array<double>").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
