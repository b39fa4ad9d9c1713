import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from commitlens.llm import tokenfiles, tokens
from commitlens.llm.packing import best_fit, pack
from commitlens.llm.tokens import Encoder, token_pieces

TEXTS = [
    "", None, "a", " a", "a ", "a  b", "a\n\nb", "\na", "a\n", "a \n b", "a\tb", "x<|endoftext|> y", "I'll don't it's",
    "Ünïcode 12³ 4.5,6", "a, b. c.,d ,e .", "\n", "  ", "日本 語。", "ɐb ǅx", "a\r\nb c", "\x1c a", "a \x85b", "word,. x",
    "long text " * 3000, "line\nfeed\n" * 2500,
]


@pytest.fixture(scope="module")
def library(vocabulary):
    tokenizer = Tokenizer.from_file(vocabulary)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(vocabulary, library, monkeypatch):
    rnd = random.Random(2)
    letters = ["a", "b", "é", " ", " ", "\n", "\t", ",", ".", "'s", "1", "²", " ", "<|endoftext|>", "语", "'"]
    texts = TEXTS + ["".join(rnd.choices(letters, k=rnd.randint(1, 16))) for _ in range(3000)]
    for part in (tokens.PART, 5):
        monkeypatch.setattr(tokens, "PART", part)
        encode = Encoder(vocabulary).encode
        for text in texts[: None if part > 5 else 1500]:
            assert np.frombuffer(encode(text or ""), "<u4").tolist() == library(text)


@pytest.mark.parametrize("size", [0, 1000, 20_000])
def test_words_are_forgotten_by_their_bytes(vocabulary, library, size):
    encoder = Encoder(vocabulary, size)
    rnd = random.Random(4)
    text = " ".join(rnd.choice(["one", "two,", "three.", "vier$$$", "fünf!!", "x-y", "a1b2"]) + "abcdefg"[: rnd.randrange(7)] for _ in range(2000))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library(text)
    for words in (encoder.first, encoder.next):
        kept = sum(tokens.getsizeof(w) + len(i) + tokens.ENTRY_BYTES for part in (words, words.old) for w, i in part.items())
        assert kept <= max(size, 2000)
    assert len(encoder.next) + len(encoder.next.old) < (20 if size < 5000 else 200)


def test_pieces(documents, vocabulary, library, clashing):
    rows = [(None if i == 3 else i, t) for i, t in enumerate(TEXTS)] + [(2, "a"), (2, "a")]
    got = token_pieces(clashing(documents(*rows)), vocabulary, length=16).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, t in rows:
        if i == 2:
            continue
        ids = library(t) + [0]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 16)))
        assert b"".join(r.ids for r in parts) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        assert all(r.length == 16 for r in parts[1:]) and all(len(r.ids) == 4 * r.length for r in parts)
    assert len(by_doc[2]) == 3


def brute_best_fit(lengths, capacity):
    """Best-fit decreasing, piece by piece: the gaps that are left."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - n)
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_sweeps_equal_best_fit_piece_by_piece(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 7, 64, 100])
    lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 400))]
    lengths += [min(5, capacity)] * (150 if seed % 2 else 0)
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    filled, ranks = defaultdict(list), defaultdict(set)
    for length, rank, many, first, offset in best_fit(counts, capacity):
        for i in range(many):
            filled[first + i].append((offset, length))
            assert rank + i not in ranks[length]
            ranks[length].add(rank + i)
    assert {n: set(range(c)) for n, c in counts.items()} == dict(ranks)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert sorted(capacity - sum(n for _, n in p) for p in filled.values()) == brute_best_fit(lengths, capacity)


def test_pack(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 0, 3, 17, 40, 64, 65, rnd.randint(1, 64)]), "x", "y", -1) for i in range(700)]
    rows += [(1000, 64, "x", "y", -1)] * 300
    df = spark.createDataFrame(rows, "id long, length int, _task string, size string, offset long").repartition(5)
    got = pack(df, capacity=64).collect()
    assert pack(df, capacity=64).columns == ["id", "length", "_task", "size", "sequence_id", "offset"]
    assert len(got) == len(rows)
    filled = defaultdict(list)
    for r in got:
        if r.length is None or not 1 <= r.length <= 64:
            assert r.sequence_id is None and r.offset is None
        else:
            filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    fits = [r[1] for r in rows if r[1] and r[1] <= 64]
    assert len(filled) == len(brute_best_fit(fits, 64))
    assert pack(df.limit(0), capacity=64).collect() == []


@pytest.mark.parametrize("ids", [[0] * 512, list(range(512)), [7] * 510 + [2**32 - 1, 0], [2**32 - 1] * 512])
def test_blocks_round_trip(ids):
    values = np.array(ids * 3, np.uint32)
    blocks = tokenfiles.encode_blocks(values)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].tolist()
    assert (tokenfiles.decode_blocks(b"".join(blocks), starts) == values).all()


def test_outliers_become_exceptions():
    values = np.array([i % 16 for i in range(512)], np.uint32)
    values[100] = 50_000
    (block,) = tokenfiles.encode_blocks(values)
    least, width, exceptions = tokenfiles.HEADER.unpack_from(block)
    assert (least, width, exceptions) == (0, 4, 1)
    assert len(block) == tokenfiles.HEADER.size + 4 * 512 // 8 + 2 + 4


def test_files_round_trip(documents, vocabulary, library, clashing):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices(["word", "other,", "é", "\n"], k=rnd.randint(0, 60)))) for i in range(-30, 200)]
    rows += [(500 + i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (7, "same id")]
    rnd.shuffle(rows)
    got = tokenfiles.token_round_trip(clashing(documents(*rows).repartition(4)), vocabulary).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    start, seen = 0, []
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
        seen.append(r.doc_id)
    assert [i for i in seen if i is not None] == sorted(i for i, _ in rows if i is not None) and seen[-1] is None
    found = sorted((r.doc_id or 10**6, zlib.crc32(r.ids)) for r in got)
    assert found == sorted((i or 10**6, zlib.crc32(np.array(library(t) + [0], "<u4").tobytes())) for i, t in rows)
    assert tokenfiles.token_round_trip(documents(), vocabulary).collect() == []


def test_broken_files_are_refused(tmp_path):
    import pyarrow.fs as pafs

    path = tmp_path / "x.pfor"
    with path.open("wb") as out:
        writer = tokenfiles.Writer(out)
        writer.add(1, np.arange(700, dtype="<u4").tobytes())
        writer.close()
    whole = path.read_bytes()
    store = pafs.LocalFileSystem()

    def read():
        with store.open_input_file(str(path)) as source:
            return list(tokenfiles.read_documents(source))

    assert read() == [(1, 0, np.arange(700, dtype="<u4").tobytes())]
    for broken in (b"", whole[:-1], whole[:20] + whole[28:], b"X" + whole[1:]):
        path.write_bytes(broken)
        with pytest.raises(tokenfiles.FileError):
            read()


def test_texts_encoded_together_have_the_ids_of_the_library(vocabulary, library, monkeypatch):
    """White space of all kinds about words, signs, added tokens, long texts; whatever stands together, and a word is looked up once."""
    rnd = random.Random(5)
    words = ["the", "Été", "été,", "a" * 30, "it's", "x)!", "(y", "!" * 9, "end" + "." * 9, "日本", "1,5", "<|endoftext|>", "ab<|endoftext|>", "tab\tin", " led", "ed\x0b", "ß", "ſt", "Ɏ", "é"]
    texts = [rnd.choice(["", " "]) + "".join(rnd.choice(words) + rnd.choice([" "] * 8 + ["\n"] * 3 + ["  ", "\n\n", " \n"]) for _ in range(rnd.randrange(12))).rstrip(rnd.choice(["", " ", "\n "])) for _ in range(600)]
    texts += ["", " ", "\n", "\na", "a\n", " \na", "  a", "plain words\nand lines", " led by one space\nand lines", "long text " * 60_000]
    want = [np.array(library(t), "<u4").tobytes() for t in texts]
    assert list(Encoder(vocabulary).encode_all(texts)) == want
    monkeypatch.setattr(tokens, "TOGETHER", 50)
    assert list(Encoder(vocabulary, 20_000).encode_all(texts)) == want
    assert list(Encoder(vocabulary).encode_all([])) == []
    monkeypatch.undo()
    asked = []
    encoder = Encoder(vocabulary)
    find = encoder._led
    monkeypatch.setattr(encoder, "_led", lambda word: asked.append(word) or find(word))
    list(encoder.encode_all(["one two three, four\nfive two"] * 50))
    assert len(asked) == len(set(asked)) <= 7
