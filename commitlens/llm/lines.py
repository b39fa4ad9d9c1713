"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from commitlens.llm.common import SPACE, ascii_lower, new_folder, partitions, stored

BUCKET_ROWS = 250_000  # lines for each bucket of a run, so that runs aren't many small files
LAST = (1 << 63) - 1  # stands for a null id: such documents come after all others


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


@dataclass
class LineIndex:
    """The line hashes of all batches so far, with the smallest document that holds each.

    A run is a table bucketed and sorted by hash, so that an anti-join merges it as it is stored and
    only the new batch is shuffled. A batch adds a run of level 0; ``fanout`` runs of one level are
    merged into one of the next, so after n batches there are at most ``fanout * log(n)`` runs, and
    a hash is rewritten ``log(n)`` times. Runs hold disjoint hashes. Batches come in document order.
    """

    spark: SparkSession
    buckets: int
    fanout: int = 4
    levels: list[list[str]] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: ``key`` and ``holder`` (a document's place in order), any number of rows a key."""
        first = batch.groupBy("key").agg(F.min("holder").alias("holder"))
        new = reduce(lambda left, run: left.join(run.hint("merge"), "key", "left_anti"), self.runs(), first)
        self._push(self._written(new), 0)

    def holders(self) -> DataFrame:
        return reduce(DataFrame.unionAll, self.runs())

    def drop(self) -> None:
        """Gives the runs' storage back; an index that later batches go on with is kept instead."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = []

    def _written(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = run.select("key", "holder").repartition(self.buckets, "key")
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name

    def _push(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            merged = self._written(reduce(DataFrame.unionAll, map(self.spark.table, self.levels[level])))
            for old in self.levels[level]:
                self.spark.sql(f"DROP TABLE {old}")
            self.levels[level] = []
            self._push(merged, level + 1)


def line_keys(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """``holder``, ``version`` (of the text), ``pos`` and ``key`` of each line whose key is long enough."""
    lines = docs.select(
        F.coalesce(F.col(id_col), F.lit(LAST)).alias("holder"),
        F.xxhash64(text_col).alias("version"),
        F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"),
    )
    keyed = lines.select("holder", "version", "pos", line_key(F.col("line")).alias("line"))
    keyed = keyed.filter(F.char_length("line") >= min_chars)
    return keyed.select("holder", "version", "pos", F.unhex(F.md5("line")).alias("key"))


def batch_bounds(docs: DataFrame, batches: int, id_col: str) -> list[int]:
    """Ids that cut the documents into about equal batches, ascending."""
    shares = [i / batches for i in range(1, batches)]
    holder = F.coalesce(F.col(id_col), F.lit(LAST))
    return sorted(set(docs.agg(F.percentile_approx(holder, shares, 1000)).first()[0] or []))


def keys_by_batch(keys: DataFrame, bounds: list[int]) -> tuple[DataFrame, int]:
    """``keys`` written once, a folder a batch, so that a batch reads nothing but its own; and the number of batches."""
    batch = reduce(lambda n, bound: n + F.when(F.col("holder") > bound, 1).otherwise(0), bounds, F.lit(0))
    path = new_folder(keys.sparkSession, "line-keys")
    keys.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    read = keys.sparkSession.read.schema(StructType([*keys.schema.fields, StructField("batch", IntegerType())]))
    return read.parquet(path), len(bounds) + 1


def line_dedup(
    docs: DataFrame,
    min_chars: int = 10,
    batches: int = 6,
    fanout: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with repeated lines removed, and ``n_lines`` and ``n_dropped`` of each text.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least
    ``min_chars`` code points stays only in the smallest document that holds it, there with all its
    lines; shorter ones always stay. Lines are told apart by the MD5 of their keys.

    Ids are integers. Documents arrive in ``batches`` of ascending id, as crawls would. Each is merge-anti-joined with
    the runs of earlier lines and adds its own (``LineIndex``).

    A null or empty text is one empty line. Rows with a null id count as one document after all
    others, rows with the same id as one document. Repeated rows each keep their row. Other columns
    are returned as they are, but for ``n_lines`` and ``n_dropped``, which are replaced, and
    ``n_chars``, which follows the text. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    keys, number = keys_by_batch(line_keys(docs, min_chars, id_col, text_col), batch_bounds(docs, batches, id_col))
    buckets = min(partitions(spark), max(1, -(-keys.count() // BUCKET_ROWS)))
    index = LineIndex(spark, buckets, fanout)
    for batch in range(number):
        index.add(keys.filter(F.col("batch") == batch))
    kept = index.holders()
    dropped = keys.join(kept.hint("merge"), "key").filter(keys["holder"] != kept["holder"])
    # Repeated rows repeat their positions, hence the set: at most one entry a line of the text.
    by_text = dropped.groupBy(keys["holder"].alias("in_holder"), F.col("version").alias("in_version")).agg(
        F.collect_set("pos").alias("gone")
    )
    by_text = stored(by_text, "dropped-lines")
    index.drop()
    # The row travels as one column, so that its names can't clash with those used here.
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows = docs.select(
        F.struct(*own).alias("row"),
        F.coalesce(F.col(id_col), F.lit(LAST)).alias("holder"),
        F.xxhash64(text_col).alias("version"),
    )
    joined = rows.join(by_text, (F.col("holder") == F.col("in_holder")) & (F.col("version") == F.col("in_version")), "left")
    old = F.col("row").getField(text_col)
    lines = joined.select("row", "gone", split_lines(old).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    joint = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(F.col("gone").isNull(), old).otherwise(joint)
    out = lines.select(
        *[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in own],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    if "n_chars" in own:
        changed = F.when(F.col("n_dropped") > 0, F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", changed.otherwise(F.col("n_chars")))
    return out
