import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from commitlens.llm.mixing import mix, mixed_documents, source_targets, taken_words


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Sharing out again and again until no target is above its stop."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return stopped | share
        for s in above:
            stopped[s] = float(most * sizes[s])
            left -= stopped[s]


ROWS = [(i, " ".join(["word"] * (i * 7 % 40 + 1)), "abcdefg"[min(i % 9, 6)]) for i in range(300)] + [
    (300, "tiny source here", "Z"),
    (301, None, "b"),
    (302, "", "b"),
    (None, "null id\tand three more", "c"),
    (303, "null source counts too", None),
    (304, "null source counts too", None),
    (5, " ".join(["word"] * 36), "f"),
    (5, " ".join(["word"] * 36), "f"),
    (305, "long " * 20_000, "e"),
    (306, "no\x0bbreak space", "😀"),
]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, None: 100, "c": 3}, {"a": 1}, {"a": 0, "b": 5}, {"x": 1000, "y": 1, "z": 1, "é": 7}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))


@pytest.mark.parametrize("block", [1, 16, 256])
def test_taken(documents, block):
    got = taken_words(documents(*ROWS), block=block).collect()
    assert len(got) == len(ROWS)
    sizes = Counter()
    for _, text, source in ROWS:
        sizes[source] += words(text)
    targets = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert taken[source] == round(target)


def test_reruns_agree_and_order_of_rows_does_not_matter(documents):
    first = sorted(map(str, taken_words(documents(*ROWS)).collect()))
    assert first == sorted(map(str, taken_words(documents(*ROWS[::-1]).repartition(3)).collect()))


def test_slots_follow_the_points(documents):
    """The schedule read in order stays close to the shares all the way."""
    docs = documents(*[(i, "w " * 64, "ab"[i % 2]) for i in range(800)])
    _, passages = mix(docs, weights=(3, 1), block=16)
    rows = sorted((r.slot, r.source, r.words) for r in passages.groupBy("slot", "source").agg(F.sum("words").alias("words")).collect())
    assert len({s for s, _, _ in rows}) == len(rows) == 800 * 64 // 16
    seen = 0
    for n, (_, source, _) in enumerate(rows, 1):
        seen += source == "a"
        assert abs(seen - 0.75 * n) < 6


def test_blocks_are_read_through_before_they_repeat(documents):
    docs = documents(*[(i, "w " * 10, "ab"[i < 5]) for i in range(60)])
    placed, passages = mix(docs, block=4)
    start = {(r.source, r.place): r.size for r in placed.collect()}
    by_epoch = defaultdict(set)
    for r in passages.collect():
        for w in range(r.start, r.start + r.words):
            key = (r.source, r.place, w)
            assert key not in by_epoch[r.source, r.epoch]
            by_epoch[r.source, r.epoch].add(key)
    for (source, epoch), found in by_epoch.items():
        if (source, epoch + 1) in by_epoch:
            assert len(found) == sum(n for (s, _), n in start.items() if s == source)


def test_documents_of_the_mix(documents, clashing):
    docs = clashing(documents(*ROWS))
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    copies = Counter((r.doc_id, r.source, r.text) for r in got.collect())
    rows = Counter((i, s, t) for i, t, s in ROWS)
    assert set(copies) <= set(rows)
    assert all(n <= 3 * rows[k] for k, n in copies.items())
    placed, _ = mix(docs)
    targets = {r.source: (r.target, r.largest) for r in placed.groupBy("source").agg(F.first("target").alias("target"), F.max("size").alias("largest")).collect()}
    for source, (target, largest) in targets.items():
        assert abs(sum(n * words(t) for (_, s, t), n in copies.items() if s == source) - target) <= largest + 1


def test_empty_and_wordless_tables(documents):
    assert taken_words(documents()).collect() == []
    got = taken_words(documents((1, ""), (2, None))).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    assert mixed_documents(documents((1, ""))).collect() == []


def test_no_python_in_the_plan(documents, capsys):
    taken_words(documents(*ROWS)).explain()
    assert "Python" not in capsys.readouterr().out


def test_shuffle_is_by_md5_of_the_id(documents):
    placed, _ = mix(documents(*[(i, "w") for i in range(50)]))
    order = [r.doc_id for r in placed.orderBy("place").collect()]
    assert order == sorted(range(50), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
