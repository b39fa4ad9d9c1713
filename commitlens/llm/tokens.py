"""Token ids of whole texts, with the ids of words kept from text to text."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import attrgetter
from sys import byteorder, getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from commitlens.llm.common import modest_batches

ID = np.dtype("<u4")
CACHE_BYTES = 32 << 20  # what a Python worker keeps of words and their ids
ENTRY_BYTES = 137  # of a word's place in a table and of its ids
PART = 1 << 18  # characters of a long text that are encoded at once
BATCH_BYTES = 4 << 20
TOGETHER = 4 << 20  # characters of texts whose words are looked up together
_RUN = re.compile(r"\S(?=\s)")
# Latin letters, the same whatever edition of Unicode the library knows, and signs of ASCII but the apostrophe.
_LETTERS = frozenset(chr(c) for first, last in ("AZ", "az", "ÀÖ", "Øö", "øɏ") for c in range(ord(first), ord(last) + 1))
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
MOST_SIGNS = 8  # behind a word whose ids are found apart
_PAIRS = ("  ", "\n\n", " \n", "\n ")


def byte_alphabet() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in shown else next(others)) for b in range(256)}


class OddSpace(Exception):
    """White space that the split into words doesn't foresee."""


class Words(dict):
    """Ids of words, as bytes, each encoded when first met. ``lead`` is what stands before a word.

    What is kept is bounded in bytes, in two generations: once the younger has taken up half of them it
    becomes the older, and what the older held is forgotten. A word met again goes to the younger.
    """

    def __init__(self, tokenizer: Tokenizer, lead: str, limit: int) -> None:
        super().__init__()
        self.tokenizer, self.model, self.lead = tokenizer, tokenizer.model, lead
        self.limit, self.held, self.old = limit // 2, 0, {}
        self.alphabet = byte_alphabet()
        self.mark = lead.translate(self.alphabet)
        self.signs: dict[str, bytes] = {}
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.single = any(map(_LETTERS.issuperset, added))  # then the library looks for them in every word
        self.added = [t for t in added if _LETTERS.issuperset(t.rstrip(_SIGNS))]  # others are in no word of letters and signs behind them

    def ids(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word) or self._encoded(word)
        size = getsizeof(word) + len(found) + ENTRY_BYTES
        if self.held + size > self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += size
        self[word] = found
        return found

    def _encoded(self, word: str) -> bytes:
        # A run of letters or of signs is one piece for the vocabulary's pattern, so the merges alone decide.
        stem = word.rstrip(_SIGNS)
        if stem.isalpha() if stem.isascii() else _LETTERS.issuperset(stem):
            if len(stem) == len(word):
                return self.ids(self.lead + word) if self.single else self._piece(self.mark, word)
            if len(word) - len(stem) <= MOST_SIGNS and not (self.added and any(map(word.__contains__, self.added))):
                signs = word[len(stem) :]
                return self[stem] + (self.signs.get(signs) or self._signs(signs))
        if word[0].isspace() or word[-1].isspace():
            raise OddSpace
        return self.ids(self.lead + word)

    def _signs(self, signs: str) -> bytes:
        if len(self.signs) >= 10_000:
            self.signs.clear()
        self.signs[signs] = found = self._piece("", signs)
        return found

    def _piece(self, mark: str, run: str) -> bytes:
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet)
        return _packed(map(_ID_OF, self.model.tokenize(mark + shown)))


_ID_OF = attrgetter("id")


def _packed(ids: Iterable[int]) -> bytes:
    found = array("I", ids)
    if byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Encoder:
    """Encodes as the tokenizers library does, for byte-level vocabularies without a prefix space.

    Their pattern never joins white space to what stands before it, and takes one space along with
    what follows. So a text may be cut before any run of white space, and before and after a single
    line feed. Words between single spaces are therefore encoded apart and remembered; a text with
    other white space goes to the library as it is, in parts that end before white space.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        # Few words begin a line.
        self.first = Words(self.tokenizer, "", cache_bytes // 4)
        self.next = Words(self.tokenizer, " ", cache_bytes - cache_bytes // 4)
        self.line_feed = self.first.ids("\n")

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._part, _parts(text)))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """``encode`` of each text; a word is looked up once for many of them."""
        first = size = 0
        for i, text in enumerate(texts):
            if i > first and size + len(text) > TOGETHER:
                yield from self._all(texts[first:i])
                first, size = i, 0
            size += len(text)
        yield from self._all(texts[first:])

    def _all(self, texts: list[str]) -> Iterator[bytes]:
        plain = [len(text) <= PART and _plain(text[1:] if text[:1] == " " else text) for text in texts]
        found = self._together([text for text, p in zip(texts, plain, strict=True) if p])
        for text, p in zip(texts, plain, strict=True):
            ids = next(found) if p else None
            yield self.encode(text) if ids is None else ids

    def _together(self, texts: list[str]) -> Iterator[bytes | None]:
        """Ids of texts of words between single spaces and line feeds; nothing for those with other white space about a word."""
        if not texts:
            return
        # Each line begins with its line feed, a text with one more: what begins no line has a space before it.
        parts = pc.split_pattern(pa.array([f"\n{text}".replace("\n", " \n") for text in texts], pa.string()), " ")
        coded = parts.flatten().dictionary_encode()
        words, of = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        known = [self._led(word) if ids is None else ids for word, ids in zip(words, map(self.next.get, words), strict=True)]
        odd = [i for i, ids in enumerate(known) if ids is None]
        for i in odd:
            known[i] = b""
        size = np.fromiter(map(len, known), np.int64, len(known)) // ID.itemsize
        start = np.cumsum(size) - size
        many = size[of]
        ends = np.cumsum(many)
        ids = np.frombuffer(b"".join(known), ID)[np.arange(ends[-1]) + np.repeat(start[of] - (ends - many), many)]
        bounds = parts.offsets.to_numpy()
        strange = np.logical_or.reduceat(np.isin(of, odd), bounds[:-1]) if odd else np.zeros(len(texts), bool)
        cuts = np.concatenate([[0], ends])[bounds].tolist()
        lead = len(self.line_feed) // ID.itemsize
        for a, b, without in zip(cuts, cuts[1:], strange.tolist(), strict=False):
            yield None if without else ids[a + lead : b].tobytes()

    def _led(self, word: str) -> bytes | None:
        if not word:
            return b""
        try:
            if word[0] != "\n":
                return self.next[word]
            return self.line_feed + self.first[word[1:]] if len(word) > 1 else self.line_feed
        except OddSpace:
            return None

    def _part(self, text: str) -> bytes:
        led = text[:1] == " "
        body = text[1:] if led else text
        if _plain(body):
            try:
                return self._words(body, led)
            except OddSpace:
                pass
        return self.first.ids(text) if text else b""

    def _words(self, text: str, led: bool) -> bytes:
        out, following = [], self.next.__getitem__
        for line in text.split("\n"):
            words = line.split(" ")
            out.append((self.next if led else self.first)[words[0]])
            out.extend(map(following, words[1:]))
            out.append(self.line_feed)
            led = False
        out.pop()
        return b"".join(out)


def _plain(body: str) -> bool:
    """Whether words may stand between single spaces and line feeds only."""
    return bool(body) and not any(p in body for p in _PAIRS) and not (body[0].isspace() or body[-1].isspace())


def _parts(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PART:
        run = _RUN.search(text, start + PART)
        if run is None:
            break
        yield text[start : run.end()]
        start = run.end()
    yield text[start:] if start else text


@lru_cache(maxsize=1)
def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """One encoder a Python worker, kept from task to task."""
    return Encoder(path, cache_bytes)


def token_pieces(
    docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    cache_bytes: int = CACHE_BYTES,
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids`` of every document's ids and an end id.

    ``ids`` are little-endian unsigned 32-bit integers. Documents of more than ``length`` ids are
    cut into pieces of ``length``, of which the first may be shorter; ``start`` counts the ids before
    a piece. A null text is empty: the end id alone. Null ids and repeated rows are documents like
    others, other columns are ignored. A Python worker keeps ``cache_bytes`` of words and their ids.
    """
    modest_batches(docs.sparkSession)
    end = np.array([end_id], ID).tobytes()
    size = ID.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, cache_bytes).encode
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // size
                start = 0
                for piece in range(-(-n // length)):
                    stop = min(start + (n % length or length if piece == 0 else length), n)
                    rows.append((doc, piece, start, stop - start, ids[start * size : stop * size]))
                    start = stop
                held += len(ids)
                if held > BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)

    doc_type = docs.schema[id_col].dataType.simpleString()
    schema = ["doc_id", "piece", "start", "length", "ids"]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {doc_type}, piece int, start long, length long, ids binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)
