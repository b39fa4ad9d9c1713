"""Comparison of a Spark result with its DuckDB oracle, without regard to row order."""

from __future__ import annotations

import math
from collections.abc import Iterable
from pathlib import Path

import duckdb

TABLES = ("lineitem", "orders", "supplier", "nation")


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def oracle_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def _sort_key(row: tuple) -> tuple:
    return tuple((v is not None, round(v, 6) if isinstance(v, float) else v) for v in row)


def sorted_rows(columns: list[str], rows: Iterable[tuple]) -> tuple[list[str], list[tuple]]:
    """Rows with columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=_sort_key)


def same(left, right) -> bool:
    if isinstance(left, float) and isinstance(right, float):
        return left == right or math.isclose(left, right, rel_tol=1e-12, abs_tol=1e-9)
    return type(left) is type(right) and left == right


def differences(spark_df, connection, sql: str) -> list[str]:
    """Why the two results differ, or that they are empty; nothing when they agree on some rows."""
    names, rows = sorted_rows(spark_df.columns, map(tuple, spark_df.collect()))
    oracle_names, expected = sorted_rows(*oracle_rows(connection, sql))
    if names != oracle_names:
        return [f"columns {names} against {oracle_names}"]
    if not rows or len(rows) != len(expected):
        return [f"{len(rows)} rows against {len(expected)}"]
    return [
        f"row {i}, {name}: {a!r} against {b!r}"
        for i, (row, want) in enumerate(zip(rows, expected, strict=True))
        for name, a, b in zip(names, row, want, strict=True)
        if not same(a, b)
    ]
