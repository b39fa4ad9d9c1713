"""Session settings the reports rely on or gain from."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # A charge's day is taken in UTC when the time column carries a zone.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning sizes the shuffle partitions, so the initial number may be generous.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Column expressions need no call site each; recording one costs several driver round trips.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configured(builder: SparkSession.Builder, **extra: str) -> SparkSession.Builder:
    """``builder`` with the settings above; ``extra`` adds or overrides any, dots as ``__``."""
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder


def local_session(cores: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("commitlens")
    settings = {
        "spark__sql__shuffle__partitions": str(cores),
        "spark__driver__memory": memory,
        "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false",
        "spark__sql__catalogImplementation": "in-memory",
        **extra,
    }
    return configured(builder, **settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where none is named, a local session uses one beside its warehouse; elsewhere that is an error,
    because a machine's own folder would lose data with an executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
