"""Helpers of the operators: shared storage, words, running sums over many tasks, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitlens.session import shared_folder

# White space that separates words and is stripped from lines; a word is a run of anything else.
SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and kept if executors go."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def modest_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Lets Spark send Python workers at most ``size`` bytes at once, for tasks that hold much besides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(size))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII, the common case, takes the faster function."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def text_parts(text: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """``text`` in parts of about ``limit`` bytes that end at white space, so no word is cut."""
    start = 0
    while len(text) - start > limit:
        blank = _BLANK.search(text, start + limit)
        if blank is None:
            break
        yield text[start : blank.end()]
        start = blank.end()
    yield text[start:] if start else text


def running_before(
    df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], **values: Column
) -> DataFrame:
    """Adds for each of ``values`` its sum over the rows before, within ``group``.

    ``bucket`` cuts each group into consecutive pieces: it must not fall along ``order``. Sums run
    within a piece, and the pieces' totals are summed up apart, so that no task needs a whole group.
    Group columns may be null.
    """
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pieces = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, bucket).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    bases = totals.select(
        *[F.col(c).alias(f"_{c}") for c in (*group, bucket)],
        *[F.coalesce(F.sum(n).over(pieces), F.lit(0)).alias(f"_base_{n}") for n in values],
    )
    local = df.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(n) for n, v in values.items()])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*group, bucket)]
    # The sizes of rows made by explode() are underestimated; a hint keeps them from a broadcast.
    joined = local.hint("merge").join(bases, on=same, how="inner")
    return joined.select(
        *df.columns, *[(F.col(n) + F.col(f"_base_{n}")).cast("long").alias(n) for n in values]
    )


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node of ``edges``.

    Alternating large-star and small-star steps: each links a node's neighbours to the smallest of
    them, which keeps connectivity, until every component is a star. Each step writes its links to
    the shared folder. The links stay as many as there were; a node with very many neighbours is
    reduced by a partial minimum first. Empty links give an empty result.
    """
    u, v = F.col(left), F.col(right)
    links = edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    links = stored(links, "links")
    before = None
    while True:
        # Large star: a node's larger neighbours are linked to the smallest node it knows, itself included.
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: its smaller neighbours and itself are linked to the smallest of them.
        large = large.distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.unionAll(small_least.select("u", F.col("m").alias("v"))).distinct(), "links")
        # Sums as decimals: they can't overflow, and stay the same only when nothing changed.
        now = links.agg(F.count("u"), F.sum(F.col("u").cast("decimal(20,0)")), F.sum(F.col("v").cast("decimal(20,0)")), F.count_distinct("u")).first()
        if now == before and now[0] == now[3]:
            break
        before = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
