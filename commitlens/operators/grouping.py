"""Grouped sums and counts, and their projection onto a report's columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(*measures: str) -> list[Column]:
    """Sums that keep the names of their measures until the report's last projection."""
    return [F.sum(m).alias(m) for m in measures]


def distinct(**counts: str) -> list[Column]:
    """Exact distinct counts: result name to counted column."""
    return [F.countDistinct(column).alias(name) for name, column in counts.items()]


def project(groups: DataFrame, keys: Sequence[str], columns: Mapping[str, Column | str]) -> DataFrame:
    """``keys`` and then ``columns`` by name; a string stands for the column as it is."""
    named = [
        (F.col(column) if isinstance(column, str) else column).alias(name)
        for name, column in columns.items()
    ]
    return groups.select(*keys, *named)
