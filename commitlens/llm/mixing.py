"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import running_before, stored, word_count

# Points of the schedule: multiples of the golden ratio's fraction, in 2**-40, modulo 1.
POINT_BITS = 40
GOLDEN = round(0.6180339887498949 * (1 << POINT_BITS)) | 1
CELL_BITS = 12
CHUNK = 1 << 14  # slots that are ranked in one piece
PIECE = 2_000  # documents (of all sources) whose sizes are summed up in one piece, source by source


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target``: one row a source.

    Sources in code point order, null last, take ``weights`` in turn and share all sizes by them. A
    target stops at ``most`` times its source's size; the excess goes to the others by weight, until
    none is above. Filling sources in the order in which they come to their stop gives that at once:
    a source stops if its stop is below what a unit of weight gets of what the ones before leave.
    The windows hold one row for each source, which is as long as the recipe of the mix.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.select("*", place.alias("place"), weight.alias("weight"))
    stop = F.col("source_size") * most
    fill = Window.orderBy(stop / F.col("weight"), "place")
    earlier, later = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(stop).over(earlier), F.lit(0))
    level = left / F.sum("weight").over(later)
    sources = sources.select("*", stop.alias("stop"), level.alias("level"))
    stops = F.col("stop") / F.col("weight") <= F.col("level")
    sources = sources.select("*", stops.alias("stops"))
    # Behind the first source that doesn't stop, levels only fall: the greatest is the final one.
    final = F.max(F.when(~F.col("stops"), F.col("level"))).over(whole)
    target = F.when(F.col("stops"), F.col("stop").cast("double")).otherwise(final * F.col("weight"))
    return sources.select("source", "source_size", "weight", target.alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """Slots of the mix: ``slot``, ``source``, ``epoch``, ``block``, ``take`` (its words).

    A source of S words is a stream of ceil(S / block) blocks, read again when it ends. Slot i gets
    the point i * golden ratio (mod 1); the sources' shares, laid end to end, tell whose slot it is.
    A slot's rank among those of its source is the block it takes. A source leaves slots beyond its
    target; where its slots end too early (by the discrepancy, a few blocks), more follow at the end
    of the schedule. Of the last block only what the target asks for is taken.
    """
    size, want = F.col("source_size"), F.round("target").cast("long")
    blocks = F.ceil(size / block)
    need = F.expr("want div source_size") * F.col("blocks") + F.ceil(F.expr("want % source_size") / block)
    sources = targets.filter(size > 0).select("source", "source_size", want.alias("want"), blocks.alias("blocks"))
    sources = sources.select("*", need.alias("need")).filter(F.col("need") > 0)
    whole, ahead = Window.partitionBy(F.lit(0)), Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.select("*", F.sum("need").over(whole).alias("slots"), F.sum("need").over(ahead).alias("up_to"))

    def point(slots: Column) -> Column:
        return F.floor(slots.cast("double") / F.col("slots") * (1 << POINT_BITS)).cast("long")

    last = F.when(F.col("up_to") == F.col("slots"), F.lit(1 << POINT_BITS)).otherwise(point(F.col("up_to")))
    sources = stored(sources.select("*", point(F.col("up_to") - F.col("need")).alias("low"), last.alias("high")), "sources")

    width = POINT_BITS - CELL_BITS
    cells = sources.filter("high > low").select(
        "source", "low", "high", F.explode(F.sequence(F.shiftright("low", width), F.shiftright(F.col("high") - 1, width))).alias("cell")
    )
    chunks = sources.agg(F.first("slots").alias("slots")).filter("slots > 0")
    chunks = chunks.select("slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"))
    last_slot = F.least((F.col("chunk") + 1) * CHUNK, F.col("slots")) - 1
    slots = chunks.repartition("chunk").select("chunk", F.explode(F.sequence(F.col("chunk") * CHUNK, last_slot)).alias("slot"))
    # i * GOLDEN mod 2**40 in two halves of i, so that no product leaves 64 bits (i below 2**44).
    mask, half = (1 << POINT_BITS) - 1, POINT_BITS // 2 + 2
    upper = (GOLDEN << half) & mask
    i = F.col("slot") + 1
    low_part = (i.bitwiseAND(F.lit((1 << half) - 1)) * GOLDEN).bitwiseAND(F.lit(mask))
    high_part = (F.shiftright(i, half) * upper).bitwiseAND(F.lit(mask))
    slots = slots.select("*", (low_part + high_part).bitwiseAND(F.lit(mask)).alias("point"))
    slots = slots.select("*", F.shiftright("point", width).alias("cell"))
    # Slots outnumber what Spark can estimate of an explode(): written first, they are never broadcast unseen.
    owned = slots.hint("merge").join(cells, "cell").filter("point >= low and point < high")
    owned = stored(owned.select("slot", "chunk", "source"), "slots")
    ranked = running_before(owned, ["source"], "chunk", [F.col("slot")], rank=F.lit(1))
    ranked = ranked.withColumnRenamed("source", "_source")
    scheduled = ranked.join(sources, F.col("source").eqNullSafe(F.col("_source"))).filter("rank < need")
    scheduled = scheduled.select("source", "source_size", "want", "blocks", "slot", "rank")
    found = owned.groupBy("source").agg(F.count("*").alias("found")).withColumnRenamed("source", "_source")
    short = sources.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source", "source_size", "want", "blocks", "slots", "need", F.coalesce("found", F.lit(0)).alias("found")
    )
    missing = short.filter("found < need").select("*", F.sum(F.col("need") - F.col("found")).over(ahead).alias("upto"))
    tail = missing.select("*", F.explode(F.sequence(F.col("found"), F.col("need") - 1)).alias("rank"))
    tail = tail.select("source", "source_size", "want", "blocks", (F.col("slots") + F.col("upto") - F.col("need") + F.col("rank")).alias("slot"), "rank")
    both = scheduled.unionByName(tail).select("*", F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("block"))
    before = F.col("epoch") * F.col("source_size") + F.col("block") * block
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    return both.select("slot", "source", "epoch", "block", F.least(length, F.col("want") - before).alias("take"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    block: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The documents with their targets, and the passages that the mix takes, in slots.

    First: ``doc_id``, ``version`` (a hash of the text), ``source``, ``place`` (among the documents
    of the source), ``size`` (words), ``source_size``, ``target``. Second: ``slot``, ``source``,
    ``place``, ``epoch``, ``start`` and ``words`` (of the document); reading slots in order gives the mix.

    A source's documents are shuffled by the MD5 of their id, laid end to end and cut into blocks of
    ``block`` words; ``schedule`` says which slot takes which block. So a source gives its target to
    the word, no document is taken over ``most`` times, and reruns agree.

    Documents without words take part with a passage of 0 words, in the block of the word before
    them. A null source is a source, a null id an id like others; rows with the same id are ordered
    by size and text, repeated rows are several documents. A mix without words has no slots. Other
    columns are ignored; an empty table gives empty results.
    """
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("version"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")).alias("shuffle"),
    )
    sizes = stored(sizes, "sizes")
    pieces = -(-sizes.count() // PIECE)
    top = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    dealt = sizes.select("*", F.floor(top * pieces / (1 << 32)).alias("piece"))
    order = [F.col(c) for c in ("shuffle", "doc_id", "size", "version")]
    targets = stored(source_targets(sizes, weights, most), "targets")
    placed = running_before(dealt, ["source"], "piece", order, start=F.col("size"), place=F.lit(1))
    # Joined by piece too, a large source is spread.
    known = dealt.select("source", "piece").distinct().join(
        targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    ).select(F.col("source").alias("_source"), F.col("piece").alias("_piece"), "source_size", "target")
    placed = stored(
        placed.join(known, F.col("source").eqNullSafe(F.col("_source")) & (F.col("piece") == F.col("_piece"))).select(
            "doc_id", "version", "source", "place", "start", "size", "source_size", "target"
        ),
        "placed",
    )
    start, end = F.col("start"), F.col("start") + F.col("size")
    first = F.when(F.col("size") > 0, F.expr(f"start div {block}")).otherwise(F.expr(f"greatest(start - 1, 0) div {block}"))
    final = F.when(F.col("size") > 0, F.floor((end - 1) / block)).otherwise(first)
    spans = placed.select("source", "place", "start", "size", F.explode(F.sequence(first, final)).alias("block"))
    inside = F.greatest(start - F.col("block") * block, F.lit(0).cast("long"))  # place of the passage in the block
    into = F.greatest(F.col("block") * block - start, F.lit(0).cast("long"))  # and in the document
    length = F.least(end, (F.col("block") + 1) * block) - F.greatest(start, F.col("block") * block)
    spans = spans.select(F.col("source").alias("_source"), "place", F.col("block").alias("_block"), inside.alias("inside"), into.alias("start"), F.greatest(length, F.lit(0).cast("long")).alias("length"))
    slots = schedule(targets, block)
    taken = slots.hint("merge").join(spans, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    words = F.least("length", F.col("take") - F.col("inside"))
    # A passage behind the end of a cut block isn't taken; one without words is, up to that end.
    taken = taken.filter((words > 0) | ((F.col("length") == 0) & (F.col("inside") <= F.col("take"))))
    return placed.drop("start"), taken.select("slot", "source", "place", "epoch", "start", words.alias("words"))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``source_size``, ``target`` and ``taken``, the words of the mix."""
    placed, passages = mix(docs, **options)
    sums = passages.groupBy("source", "place").agg(F.sum("words").alias("taken"))
    sums = sums.select(F.col("source").alias("_source"), F.col("place").alias("_place"), "taken")
    same = placed["source"].eqNullSafe(F.col("_source")) & (placed["place"] == F.col("_place"))
    return placed.join(sums.hint("merge"), same, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Whole documents of the mix, with the columns of ``docs``: each as often as its beginning is taken.

    A document belongs to the block that its first word (or place, without words) lies in, so a
    source's share differs from its target by parts of single documents. Rows equal in id, source
    and text share their copies out, in the order of a hash of their columns (but maps).
    """
    placed, passages = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    begun = passages.filter("start = 0").groupBy(F.col("source").alias("_source"), F.col("place").alias("_place")).agg(F.count("*").alias("times"))
    same = placed["source"].eqNullSafe(F.col("_source")) & (placed["place"] == F.col("_place"))
    key = ("_id", "_src", "_version")
    counts = placed.join(begun.hint("merge"), same).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("version").alias("_version")).agg(F.sum("times").alias("_times"))
    rows = placed.groupBy(F.col("doc_id").alias("_id2"), F.col("source").alias("_src2"), F.col("version").alias("_version2")).agg(F.count("*").alias("_rows"))
    alike = [F.col(k).eqNullSafe(F.col(f"{k}2")) for k in key]
    counts = counts.hint("merge").join(rows, alike).select(*key, "_times", "_rows")
    mine = [F.col("id").eqNullSafe(F.col("_id")), F.col("source").eqNullSafe(F.col("_src")), F.col("version") == F.col("_version")]
    # The row travels as one column, so that its names can't clash with those used here.
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    named = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("version"),
        F.xxhash64(*plain).alias("turn"),
    )
    joined = named.join(counts.hint("merge"), mine)
    nth = F.row_number().over(Window.partitionBy("_id", "_src", "_version").orderBy("turn"))
    dealt = joined.select("row", "_times", "_rows", nth.alias("nth"))
    copies = F.expr("_times div _rows + if(nth <= _times % _rows, 1, 0)")
    dealt = dealt.select("row", copies.alias("copies")).filter("copies > 0")
    return dealt.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
