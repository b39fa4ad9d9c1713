"""Reading a charge table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from commitlens.schema import CHARGE_COLUMNS, TEXT_SCHEMA, conform


def read_charges(
    spark: SparkSession,
    *,
    table: str | None = None,
    path: str | Sequence[str] | None = None,
    file_format: str = "parquet",
    columns: Sequence[str] | None = None,
    month_column: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Charges of a catalog table, or of files at ``path``.

    CSV files are read by their header, JSON by field names, both without inference: measures are
    exact, times ISO text in UTC. ``options`` go to Spark's reader.

    A table of many months is best partitioned by the month of ``ChargePeriodStart``. Name that
    partition column as ``month_column`` (a date, the first of the month): it is kept as
    ``charge_month``, and the window of each report then skips the months outside it.
    """
    if (table is None) == (path is None):
        raise ValueError("give either a table name or a path")
    if table is not None:
        charges = spark.table(table)
    else:
        paths = [path] if isinstance(path, str) else list(path)
        reader = spark.read.format(file_format)
        if file_format == "csv":
            reader = reader.option("header", "true")
        elif file_format == "json":
            reader = reader.schema(T.StructType([TEXT_SCHEMA[c] for c in columns or CHARGE_COLUMNS]))
        charges = reader.options(**(options or {})).load(paths)
    return conform(charges, columns, month_column)
