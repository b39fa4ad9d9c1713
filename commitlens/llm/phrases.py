"""Phrase collocations from stripes: next-word counters of prefixes, merged element by element.

Phrases are counted in four readings of the texts. The first counts words. The second counts
hashes of pairs of frequent words, which tells the pairs that may be frequent; the third does so for
triples of such pairs. The fourth counts, as whole words, phrases all of whose pairs and triples may be:
a phrase occurs at most as often as each part of it, so none that is frequent is left out, and what
the hashes let through in error is dropped by its count.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import modest_batches, stored

PIECE_END = re.compile(rb"[.,;:!?\x0a-\x0d]")
BREAK = b"\xff"  # stands where a piece ends; UTF-8 never holds it
_BREAKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", BREAK * 10)
PART = 1 << 20  # bytes of a long text that are split at once
CHUNK, CHUNK_WORDS = 2_000_000, 400_000  # words, and different ones, that a task holds before it gives out counts
FILTER_BITS = 27  # a filter is a bitmap of 16 MB, whatever the number of hashes
SEGMENT = 1 << 15  # bits of a bitmap that Spark builds at once
WORDS_A_BUCKET, MOST_BUCKET_BITS = 250_000, 20  # what is counted is dealt to buckets by the number of words
STRIPE_PARTS = 64  # so many parts of a prefix's counter, by next word, may lie in different tasks


class Numbers(dict):
    """Numbers of one language's words, as bytes; a new word gets the next number of ``chunk``."""

    def __init__(self, chunk: Chunk, lang: str) -> None:
        super().__init__({BREAK: 0})
        self.words, self.langs, self.lang = chunk.words, chunk.langs, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return number


class Chunk:
    """Words of some texts as numbers, 0 where a piece ends."""

    def __init__(self) -> None:
        self.words, self.langs = [BREAK], [""]
        self.numbers: dict[str, Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, part: bytes) -> None:
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = Numbers(self, lang)
        # Of white space only spaces and tabs are left, so split() splits at nothing else.
        words = part.lower().translate(_BREAKS).replace(BREAK, b" \xff ").split()
        words.append(BREAK)
        self.parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def at(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def hashes(self) -> np.ndarray:
        """As Spark's xxhash64 of language and word."""
        seeds = {lang: xxhash.xxh64_intdigest(lang.encode(), 42) for lang in self.numbers}
        named = zip(self.words[1:], self.langs[1:], strict=True)
        return np.array([0, *(xxhash.xxh64_intdigest(w, seeds[lang]) for w, lang in named)], np.uint64)


def _parts(text: bytes) -> Iterator[bytes]:
    """``text`` in parts that end where a piece ends, so that no phrase is cut."""
    start = 0
    while len(text) - start > PART:
        end = PIECE_END.search(text, start + PART)
        if end is None:
            break
        yield text[start : end.end()]
        start = end.end()
    yield text[start:] if start else text


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Chunk]:
    """The words of rows (language, text as bytes), about ``size`` at a time."""
    chunk = Chunk()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in _parts(text.as_py() or b""):
                chunk.add(lang, part)
                if chunk.size >= size or len(chunk.words) >= CHUNK_WORDS:
                    yield chunk
                    chunk = Chunk()
    if chunk.size:
        yield chunk


def word_counts(texts: DataFrame, least: int, size: int = CHUNK) -> DataFrame:
    """``lang``, ``word``, ``a`` of words that occur ``least`` times; with a null word, all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, size):
            counts = np.bincount(chunk.at(), minlength=len(chunk.words))[1:]
            langs = chunk.langs[1:]
            words = pa.array(chunk.words[1:], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), words, pa.array(counts)], ["lang", "word", "a"])
            all_words: dict[str, int] = defaultdict(int)
            for lang, count in zip(langs, counts.tolist(), strict=True):
                all_words[lang] += count
            totals = [pa.array(list(all_words), pa.string()), pa.nulls(len(all_words), pa.string()), pa.array(list(all_words.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(totals, ["lang", "word", "a"])

    counted = texts.mapInArrow(run, "lang string, word string, a long").groupBy("lang", "word").agg(F.sum("a").alias("a"))
    return stored(counted.filter(F.col("word").isNull() | (F.col("a") >= least)), "words")


def hash_filter(hashes: DataFrame) -> Broadcast:
    """A bitmap of fixed size that says which values of ``hash`` may be in ``hashes``."""
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bits = F.bitmap_construct_agg((place % SEGMENT).cast("long"))
    segments = hashes.groupBy(F.floor(place / SEGMENT).alias("segment")).agg(bits.alias("bits"))
    bitmap = np.zeros((1 << FILTER_BITS) // SEGMENT * (SEGMENT // 8), np.uint8)
    for row in segments.toLocalIterator():
        first = row["segment"] * (SEGMENT // 8)
        bitmap[first : first + SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bitmap)


def _may_be(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left * np.uint64(0x9E3779B97F4A7C15) + right) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    return mixed * np.uint64(0x94D049BB133111EB)


def frequent_hashes(
    texts: DataFrame, least: int, bits: int, size: int, hashed: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> DataFrame:
    """Each ``hash`` of phrases that occur ``least`` times, and perhaps a few others.

    ``hashed`` gives the hashes to count from word numbers and their hashes. A task gives out its
    counts in buckets by the leading ``bits``; a bucket takes up the next 32, so different phrases seldom
    meet, and if they do a phrase counts as more frequent than it is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, size):
            found, counts = np.unique(hashed(chunk.at(), chunk.hashes()), return_counts=True)
            buckets = (found >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(found), np.int32)
            keys, counts = (found >> np.uint64(32 - bits)).astype(np.uint32), counts.astype(np.uint32)
            names, starts = np.unique(buckets, return_index=True)
            cuts = [*starts.tolist(), len(found)]
            slices = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            columns = [pa.array([c[s].tobytes() for s in slices], pa.binary()) for c in (keys, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *columns], ["bucket", "keys", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32) for c in ("keys", "counts"))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint32(1)))
        kept = keys[first][np.add.reduceat(counts, first) >= least].astype(np.uint64)
        bucket = np.uint64(table.column("bucket")[0].as_py())
        hashes = kept << np.uint64(32 - bits) | (bucket << np.uint64(64 - bits) if bits else np.uint64(0))
        return pa.table({"hash": hashes.view(np.int64)})

    counted = texts.mapInArrow(count, "bucket int, keys binary, counts binary")
    return stored(counted.groupBy("bucket").applyInArrow(merge, "hash long"), "frequent")


def _pairs(at: np.ndarray, hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs of words begin that may be frequent, by place, and the hashes of pairs there."""
    pair, found = np.zeros(len(at), bool), np.zeros(len(at), np.uint64)
    inner = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
    found[inner] = _pair_hashes(hashes[at[inner]], hashes[at[inner + 1]])
    pair[inner] = _may_be(known, found[inner])
    return pair, found


def _triples(at: np.ndarray, hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where triples of two such pairs begin, and their hashes."""
    pair, found = _pairs(at, hashes, known)
    places = np.flatnonzero(pair[:-1] & pair[1:])
    return places, _pair_hashes(found[places], hashes[at[places + 2]])


def _stripes(chunk: Chunk, pairs: np.ndarray, triples: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Counters of the next words of all prefixes of one to three words, by bucket.

    An entry is its language, in hexadecimal digits, prefix and next word; a line feed, which no word holds, ends each.
    """
    at, hashes = chunk.at(), chunk.hashes()
    pair, _ = _pairs(at, hashes, pairs)
    triple = np.zeros(len(at), bool)
    places, found = _triples(at, hashes, pairs)
    triple[places] = _may_be(triples, found)
    four = triple & np.append(triple[1:], False)

    word = np.array([b"", *chunk.words[1:]], object)
    names, prefix = np.array([lang.encode().hex().encode() + b"\n" + w for lang, w in zip(chunk.langs, word, strict=True)], object), at.astype(np.int64)
    marks = hashes  # of prefixes
    dealt, made, many = [], [], []
    for words, begins in ((1, pair), (2, triple), (3, four)):
        places = np.flatnonzero(begins)
        codes, number, counts = np.unique(prefix[places] << 32 | at[places + words], return_inverse=True, return_counts=True)
        before, following = codes >> 32, codes & 0xFFFFFFFF
        # A prefix's counter is cut into parts by the next word, and parts are dealt to buckets.
        part = hashes[following] % np.uint64(STRIPE_PARTS)
        dealt.append((_pair_hashes(marks[before], part) >> np.uint64(20)) % np.uint64(buckets))
        # The phrases found are the prefixes of longer ones.
        names, marks = names[before] + b" " + word[following], _pair_hashes(marks[before], hashes[following])
        made.append(names)
        many.append(counts)
        prefix = np.zeros(len(at), np.int64)
        prefix[places] = number.ravel()
    dealt, made, many = np.concatenate(dealt).astype(np.int32), np.concatenate(made), np.concatenate(many).astype(np.uint32)
    order = np.argsort(dealt, kind="stable")
    named, starts = np.unique(dealt[order], return_index=True)
    cuts = [*starts.tolist(), len(dealt)]
    slices = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    entries = pa.array([b"\n".join(made[i].tolist()) for i in slices], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(named, pa.int32()), entries, pa.array([many[i].tobytes() for i in slices], pa.binary())], ["bucket", "entries", "counts"])


def _merged(entries: list[bytes], counts: list[bytes], least: int) -> dict[tuple[bytes, bytes], dict[bytes, int]]:
    """Counters of the same prefix added up element by element, without what occurs less than ``least`` times."""
    stripes: dict[tuple[bytes, bytes], dict[bytes, int]] = defaultdict(dict)
    total: dict[tuple[bytes, bytes], int] = defaultdict(int)
    for held, numbers in zip(entries, counts, strict=True):
        parts = iter(held.split(b"\n"))
        for entry, n in zip(zip(parts, parts, strict=True), np.frombuffer(numbers, np.uint32).tolist(), strict=True):
            total[entry] += n
    for (lang, phrase), n in total.items():
        if n >= least:
            prefix, _, word = phrase.rpartition(b" ")
            stripes[lang, prefix][word] = n
    return stripes


def stripes(texts: DataFrame, pairs: Broadcast, triples: Broadcast, least: int, bits: int, size: int) -> DataFrame:
    """``lang``, ``prefix`` of ``words`` words, ``nexts`` and ``counts``: what follows it ``least`` times.

    Parts of counters from all tasks are added up element by element, in 2 ** ``bits`` buckets. A prefix
    whose counter is large has several rows with different next words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, size):
            yield _stripes(chunk, pairs.value, triples.value, 1 << bits)

    def merge(table: pa.Table) -> pa.Table:
        found = _merged(table.column("entries").to_pylist(), table.column("counts").to_pylist(), least)
        return pa.table(
            {
                "lang": pa.array([bytes.fromhex(lang.decode()).decode() for lang, _ in found], pa.string()),
                "prefix": pa.array([p for _, p in found], pa.binary()).cast(pa.string()),
                "words": pa.array([p.count(b" ") + 1 for _, p in found], pa.int32()),
                "nexts": pa.array([list(s) for s in found.values()], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                "counts": pa.array([list(s.values()) for s in found.values()], pa.list_(pa.int64())),
            }
        )

    counted = texts.mapInArrow(count, "bucket int, entries binary, counts binary")
    merged = counted.groupBy("bucket").applyInArrow(merge, "lang string, prefix string, words int, nexts array<string>, counts array<long>")
    return stored(merged, "stripes")


def _times(count: str, factor: int) -> Column:
    return F.col(count).cast("decimal(20,0)") * F.lit(factor).cast("decimal(10,0)")


def phrases(
    docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, text_col: str = "text", lang_col: str = "lang",
    size: int = CHUNK,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's best phrases.

    Texts, A-Z lower-cased, are pieces between ``.,;:!?`` and line ends, pieces are words between spaces
    and tabs. A phrase is two to four words that occur ``a`` >= ``least`` times one behind the other. Cut
    after k words its parts occur ``l`` and ``r`` times, and ``score`` is floor(2000000 * a / (l + r)) of the cut
    where that is lowest, of several the first. Phrases that lie in a longer one (up to four words) with
    at least ``share`` percent of their occurrences are left out. The first ``top`` by score, then a, both falling, then phrase
    (bytes) are returned; ``n`` is the number of words of the language. All counts are exact.

    A null language is ``und``, a null text is empty, repeated rows count as often as they occur, ids and other columns
    are ignored. A language without such phrases has no row; an empty table gives an empty result.
    A task holds about ``size`` words at once.
    """
    modest_batches(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    texts = docs.select(lang, F.col(text_col).cast("string").cast("binary").alias("text"))
    words = word_counts(texts, least, size)
    total = words.filter("word IS NULL").agg(F.sum("a")).first()[0] or 0
    bits = min(MOST_BUCKET_BITS, (total // WORDS_A_BUCKET).bit_length())
    frequent = hash_filter(words.filter("word IS NOT NULL").select(F.xxhash64("lang", "word").alias("hash")))

    def of_pairs(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        good = _may_be(frequent.value, hashes)
        good[0] = False
        both = np.flatnonzero(good[at[:-1]] & good[at[1:]])
        return _pair_hashes(hashes[at[both]], hashes[at[both + 1]])

    pairs = hash_filter(frequent_hashes(texts, least, bits, size, of_pairs))
    triples = hash_filter(frequent_hashes(texts, least, bits, size, lambda at, hashes: _triples(at, hashes, pairs.value)[1]))
    found = stripes(texts, pairs, triples, least, bits, size)

    entry = F.explode(F.arrays_zip("nexts", "counts")).alias("entry")
    each = found.select("lang", "prefix", "words", entry).select(
        "lang", F.concat_ws(" ", "prefix", "entry.nexts").alias("phrase"), (F.col("words") + 1).alias("words"), F.col("entry.counts").alias("a")
    )
    counts = words.filter("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "a").unionAll(each)
    # If a longer phrase holds enough of a phrase's occurrences, so does one that is longer by one word at an end.
    by_next = found.filter("words > 1").select("lang", F.col("prefix").alias("phrase"), F.array_max("counts").alias("longer"))
    by_previous = each.filter("words > 2").select("lang", F.expr("substring(phrase, locate(' ', phrase) + 1)").alias("phrase"), F.col("a").alias("longer"))
    longest = by_next.unionAll(by_previous).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = each.join(longest, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (_times("longer", 100) < _times("a", share))
    )
    cuts = alone.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - words)").alias("tail")
    )
    for side, count in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(count)), ["lang", side])
    # div gives whole numbers; the products are decimals.
    cuts = cuts.withColumn("twice", _times("a", 2_000_000)).withColumn("parts", _times("l", 1) + _times("r", 1))
    lowest = F.min(F.struct(F.expr("twice div parts").alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = scored.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    ranked = near.filter(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    sizes = words.filter("word IS NULL").select("lang", F.col("a").alias("n"))
    return ranked.filter(F.col("rank") <= top).join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
