"""Quality classifier: heuristic labellers, a model of their accuracies, a hashed linear scorer."""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import modest_batches, text_parts

SLOTS = 1 << 14
SAMPLE_ROWS = 20_000
GOOD, BAD = 1, 0
BAD_VOTE, GOOD_VOTE, NO_VOTE = 0, 1, 2

# Each labeller: the measure it looks at, the words it needs, below what it votes good, above what bad.
LABELLERS: tuple[tuple[str, int, float, float], ...] = (
    ("repeated_words", 5, 0.10, 0.25),
    ("repeated_pairs", 20, 0.15, 0.40),
    ("repeated_vocabulary", 50, 0.05, 0.20),
    ("symbols", 1, 0.02, 0.06),
    ("symbol_words", 5, 0.05, 0.20),
    ("marked_words", 5, 0.05, 0.30),
    ("capitals", 5, 0.20, 0.60),
    ("exclamations", 5, 0.05, 0.30),
    ("digits", 5, 0.10, 0.40),
    ("repeated_lines", 20, 0.30, 0.70),
    ("word_length", 5, 0.40, 0.70),
)
PATTERNS = 3 ** len(LABELLERS)
WINDOW = 1000  # words
UNTOLD = 0.55  # a length of words between the limits of a vote

# Bytes as classes: lower case and anything beyond ASCII a, upper case A, digits 9, the rest itself.
_SHAPES = bytes(
    ord("a") if chr(b).islower() and b < 128 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("9") if 48 <= b <= 57 else b
    for b in range(256)
)
_SPACE = b" \t\n\x0b\x0c\r"
_RUN = re.compile(rb"(.)\1+")
_INNER = bytes(range(0x80, 0xC0))  # bytes of a sign of UTF-8 but its first
_WIDE = bytes(range(0xE3, 0xEE))  # first bytes of kana, Chinese signs and Hangul
_ORDINARY = b"aA9 \t\n\x0b\x0c\r.,;:'\"-?()"


@dataclass
class Measures:
    """Shapes of the words of a text, and the numbers that labellers look at."""

    words: int
    shapes: Counter
    values: dict[str, float]


def _window(found: list[int]) -> tuple[int, int, int]:
    """Words, different words and different pairs of neighbours: told by the difference of their hashes, so equal neighbours are one pair."""
    return len(found), len(set(found)), len(set(map(operator.sub, found, [0, *found[:-1]])))


def measure(text: bytes) -> Measures:
    """Every word and line of ``text``, part by part."""
    shapes: Counter = Counter()
    lines: set[int] = set()
    words = alike = n_lines = symbols = letters = capitals = marks = digits = visible = symbol_words = marked = points = wide = 0
    last, rest = 0, b""
    waiting: list[int] = []
    windows: list[tuple[int, int, int]] = []  # words, different ones, different pairs
    for part in text_parts(text):
        shaped = part.translate(_SHAPES)
        upper, numbers = shaped.count(b"A"), shaped.count(b"9")
        capitals += upper
        digits += numbers
        letters += shaped.count(b"a") + upper
        marks += part.count(b"!")
        symbols += len(shaped.translate(None, _ORDINARY))
        shown = part.translate(None, _SPACE)
        visible += len(shown)
        points += len(shown.translate(None, _INNER))
        wide += len(shown) - len(shown.translate(None, _WIDE))
        shapes.update(shaped.split())
        found = list(map(hash, part.split()))
        before = [last, *found[:-1]]
        alike += sum(map(operator.eq, found, before))
        last = found[-1] if found else last
        words += len(found)
        waiting += found
        whole = len(waiting) - len(waiting) % WINDOW
        windows += [_window(waiting[i : i + WINDOW]) for i in range(0, whole, WINDOW)]
        waiting = waiting[whole:]
        *ended, rest = (rest + part).split(b"\n")
        lines.update(map(hash, ended))
        n_lines += len(ended)
    lines.add(hash(rest))
    if waiting and (not windows or len(waiting) >= WINDOW // 2):
        windows.append(_window(waiting))
    among = max(sum(n for n, _, _ in windows), 1)
    for shape, n in shapes.items():
        odd = len(shape.translate(None, _ORDINARY))
        symbol_words += n * (odd == len(shape))
        marked += n * (odd > 0)
    many, seen = max(words, 1), max(visible, 1)
    # Where most signs are those of scripts that leave no spaces, the length of words says nothing.
    length = UNTOLD if 2 * wide > points else min(1.0, abs(np.log(max(points / many, 0.1) / 5.5)))
    return Measures(
        words,
        shapes,
        {
            "repeated_words": alike / many,
            # By windows of as many words, since a longer text repeats more of its pairs and vocabulary. Of the
            # vocabulary, prose keeps the root at least.
            "repeated_pairs": sum(n - pairs for n, _, pairs in windows) / among,
            "repeated_vocabulary": sum(n * (1 - min(1.0, distinct / n**0.75)) for n, distinct, _ in windows) / among,
            "symbols": symbols / seen,
            "symbol_words": symbol_words / many,
            "marked_words": marked / many,
            "capitals": capitals / max(letters, 1),
            "exclamations": marks / many,
            "digits": digits / seen,
            "repeated_lines": 1 - len(lines) / (n_lines + 1),
            "word_length": length,
        },
    )


def votes(found: Measures) -> list[int]:
    """Each labeller's vote; none where the text has too few words or lies between its limits."""
    out = []
    for name, least, good, bad in LABELLERS:
        value = found.values[name]
        voted = GOOD_VOTE if value < good else BAD_VOTE if value > bad else NO_VOTE
        out.append(voted if found.words >= least else NO_VOTE)
    return out


def pattern(cast: list[int]) -> int:
    return sum(v * 3**j for j, v in enumerate(cast))


def features(found: Measures) -> tuple[np.ndarray, np.ndarray]:
    """Hashed slots and their values: shapes of words (runs cut to two) by frequency, and the steps
    that each measure reaches."""
    total: Counter = Counter()
    for shape, n in found.shapes.items():
        total[zlib.crc32(_RUN.sub(rb"\1\1", shape)) % SLOTS] += n
    slots = list(total)
    values = [(n / max(found.words, 1)) ** 0.5 for n in total.values()]
    for name, value in found.values.items():
        for step in range(int(min(value, 2.0) * 10) + 1):
            slots.append(zlib.crc32(f"{name}:{step}".encode()) % SLOTS)
            values.append(0.5)
    return np.array(slots, np.int64), np.array(values)


@dataclass(frozen=True)
class Model:
    """``table[class, labeller, vote]`` are probabilities, ``prior`` that of a good document."""

    prior: float
    table: np.ndarray
    weights: np.ndarray
    bias: float
    documents: int


def accuracies(counts: dict[int, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[int, float]]:
    """Expectation-maximisation over how many documents cast each pattern of votes.

    Given a document's class, labellers vote independently, each with its own probabilities; a vote that
    isn't cast says nothing. It gives the prior, the probabilities and each pattern's posterior.
    """
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[p] for p in patterns.tolist()], float)
    cast = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    # To begin with, a document with any bad vote is bad: a defect shows in few labellers.
    posterior = np.where((cast == BAD_VOTE).any(1), 0.02, 0.98)
    one_hot = cast[:, :, None] == np.arange(2)
    prior, table = 0.5, np.full((2, len(LABELLERS), 2), 0.5)
    for _ in range(rounds):
        sums = np.stack([(w[:, None, None] * one_hot).sum(0) for w in (weight * (1 - posterior), weight * posterior)])
        # A labeller is taken to be right more often than wrong: two extra right votes for each class.
        extra = np.full((2, 1, 2), 0.5)
        extra[BAD, :, BAD_VOTE] += 2
        extra[GOOD, :, GOOD_VOTE] += 2
        table = (sums + extra) / (sums + extra).sum(axis=2, keepdims=True)
        prior = float(((weight * posterior).sum() + 1) / (weight.sum() + 2))
        logs = (np.log(table)[:, None] * one_hot).sum(axis=(2, 3))
        new = 1 / (1 + np.exp(np.clip(logs[BAD] - logs[GOOD] + np.log((1 - prior) / prior), -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return prior, table, dict(zip(patterns.tolist(), posterior.tolist(), strict=True))


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels, both classes with equal weight, by accelerated gradient steps."""
    weights, bias = np.zeros(SLOTS), 0.0
    if not rows:
        return weights, bias
    row = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    slot, value = (np.concatenate(c) for c in zip(*rows, strict=True))
    shares = np.array([max((1 - target).sum(), 1e-3), max(target.sum(), 1e-3)]) * 2
    each = (1 - target) / shares[0] + target / shares[1]
    ahead, ahead_bias = weights.copy(), bias
    step = 1.0 / 2.0
    for t in range(1, rounds + 1):
        margin = np.bincount(row, value * ahead[slot], len(rows)) + ahead_bias
        error = each * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target)
        new = ahead - step * (np.bincount(slot, value * error[row], SLOTS) + decay * ahead)
        new_bias = ahead_bias - step * error.sum()
        pull = (t - 1) / (t + 2)
        ahead, ahead_bias = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
        weights, bias = new, new_bias
    return weights, float(bias)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The labellers vote on every document; the driver gets how many cast each pattern of votes.

    There are at most ``PATTERNS`` patterns. The posterior labels of about ``sample_rows`` documents, taken by
    a hash of id and text, train the scorer; no label from outside is used.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen[pattern(votes(measure(text.as_py() or b"")))] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()))], ["pattern", "n"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(text.as_py() or b"") for text in batch.column(0)]
            described = [features(m) for m in found]
            columns = [pa.array([pattern(votes(m)) for m in found]), *[pa.array([d[i].tolist() for d in described]) for i in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, ["pattern", "slots", "values"])

    texts = docs.select(F.col(text_col).cast("binary").alias("text"), F.xxhash64(id_col, text_col).alias("draw"))
    tallied = texts.select("text").mapInArrow(tally, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    counts = {r["pattern"]: r["n"] for r in tallied.collect()}
    if not counts:
        return Model(0.5, np.full((2, len(LABELLERS), 2), 0.5), np.zeros(SLOTS), 0.0, 0)
    prior, table, posterior = accuracies(counts)
    share = min(1.0, sample_rows / sum(counts.values()))
    drawn = texts.filter(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("text")
    sample = drawn.mapInArrow(describe, "pattern long, slots array<long>, values array<double>").toArrow()
    rows = [(np.asarray(s.values), np.asarray(v.values)) for s, v in zip(sample["slots"], sample["values"], strict=True)]
    target = np.array([posterior[p] for p in sample["pattern"].to_pylist()])
    weights, bias = train(rows, target)
    return Model(prior, table, weights, bias, sum(counts.values()))


def classify(
    docs: DataFrame, model: Model | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` with ``quality``, the scorer's probability that a text is good, and ``accepted``.

    A text is accepted from ``least`` on. Null texts and texts without a word have quality 0.
    Repeated rows are scored alike. Columns named ``quality`` or ``accepted`` are replaced, others
    stay as they are. An empty table gives an empty result.
    """
    modest_batches(docs.sparkSession)
    model = model or fit(docs, id_col=id_col, text_col=text_col, **options)
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        def one(text: bytes | None) -> float:
            found = measure(text or b"")
            if not found.words:
                return 0.0
            slots, values = features(found)
            return float(1 / (1 + np.exp(-np.clip(values @ weights[slots] + bias, -50, 50))))

        return texts.map(one).astype("float64")

    own = [c for c in docs.columns if c.lower() not in ("quality", "accepted")]
    scored = docs.select(*own, probability(F.col(text_col).cast("binary")).alias("quality"))
    return scored.withColumn("accepted", F.col("quality") >= least)
