import math
import random
import re
import zlib
from dataclasses import replace

import numpy as np
import pytest
import xxhash

from commitlens.llm.queries import op13_toxicity
from commitlens.llm.toxicity import PART, Hashes, Model, Options, fit, learn, score, slots

DOCUMENTS = "doc_id long, text string, lang string, score string, label string, key string, shard string"
LABELS = "doc_id long, toxic int, text string, label string, quality int"
MASK = (1 << 64) - 1


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "x", "x", "x", "x") for i, t in rows], DOCUMENTS).repartition(parts)


def marks(spark, rows):
    return spark.createDataFrame([(i, y, "x", "x", 1) for i, y in rows], LABELS)


def plain_slots(text, bits):
    """Features word by word, with Python's integers."""
    h = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"\w+", text.lower())]
    spread, after, over = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    found = {(x * spread & MASK) >> (64 - bits) for x in h}
    found |= {((a * after + b & MASK) * spread & MASK) >> (64 - bits) for a, b in zip(h, h[1:], strict=False)}
    found |= {((a * over + b & MASK) * spread & MASK) >> (64 - bits) for a, b in zip(h, h[2:], strict=False)}
    return sorted(found)


@pytest.mark.parametrize("text", ["", "word", "Two words", "a b c a b c", "Straße ÉTÉ, $$$ 12_3!", " \x00 - \n"])
def test_features_of_a_text(text):
    assert slots(text, Hashes(), 18).tolist() == plain_slots(text, 18)


def test_a_long_text_counts_to_its_end():
    rnd = random.Random(1)
    text = " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 9) for _ in range(PART // 2)) + " the end"
    assert len(text) > 2 * PART
    assert slots(text, Hashes(), 18).tolist() == plain_slots(text, 18)


def plain_ftrl(rows, size, o):
    """FTRL-proximal coordinate by coordinate, as published."""
    z, n = [0.0] * size, [0.0] * size

    def weight(i):
        l1 = 0.0 if i == size - 1 else o.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((o.beta + math.sqrt(n[i])) / o.alpha + o.l2)

    for at, label in rows:
        at = [*at, size - 1]
        w = [weight(i) for i in at]
        g = 1 / (1 + math.exp(-sum(w))) - label
        for i, x in zip(at, w, strict=True):
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / o.alpha
            z[i] += g - sigma * x
            n[i] += g * g
    return np.array(z), np.array(n)


def test_learning_equals_the_published_steps():
    rnd = random.Random(2)
    rows = [(sorted(rnd.sample(range(40), 8)), rnd.randrange(2)) for _ in range(300)]
    o = Options(alpha=0.7, l1=0.4, l2=0.2)
    z, n = np.zeros(41), np.zeros(41)
    met = learn(z, n, ((np.array(at, np.uint32), y) for at, y in rows), o)
    want = plain_ftrl(rows, 41, o)
    assert met.all() and np.allclose(z, want[0], atol=1e-9) and np.allclose(n, want[1], atol=1e-9)


def corpus(n=1500, seed=3):
    rnd = random.Random(seed)
    clean = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rnd.choices(clean, k=rnd.randrange(20, 400))
        toxic = i % 8 == 0
        if toxic:
            for _ in range(1 + len(words) // 80):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Awful!", "nasty", "VILE,"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_sparse_weights(spark):
    rows, labels = corpus()
    options = Options(shard_rows=300)
    model = fit(documents(spark, rows), marks(spark, labels[:1000]), options)
    assert 0 < len(model.slots) < 3000
    found = {r.doc_id: r.score for r in score(documents(spark, rows), model).collect()}
    held = labels[1000:]
    assert sum(found[i] >= 0.3 for i, y in held if y) >= 0.97 * sum(y for _, y in held)
    assert sum(found[i] >= 0.3 for i, y in held if not y) <= 0.01 * len(held)


def test_one_shard_equals_plain_steps_and_shards_are_means(spark):
    rows, labels = corpus(60)
    o = Options(epochs=1, bits=10, l1=0.2, alpha=0.5)
    by_id = dict(labels)
    keys = {r.doc_id: r.k for r in documents(spark, rows).selectExpr("doc_id", "xxhash64(doc_id, text) AS k").collect()}
    shard = {r.doc_id: r.s for r in spark.createDataFrame([(i, k) for i, k in keys.items()], "doc_id long, k long").selectExpr("doc_id", "pmod(xxhash64(k), 3) AS s").collect()}
    for shards in (1, 3):
        size, parts = (1 << 10) + 1, []
        for s in range(shards):
            own = [i for i, _ in rows if shards == 1 or shard[i] == s]
            own.sort(key=lambda i: keys[i] % (1 << 64))
            encoded = [(plain_slots(dict(rows)[i], 10), by_id[i]) for i in own]
            met = np.zeros(size, bool)
            met[[*{x for at, _ in encoded for x in at}, size - 1]] = True
            parts.append((*plain_ftrl(encoded, size, o), met))
        many = np.maximum(sum(p[2].astype(int) for p in parts), 1)
        z, n = (sum(p[k] * p[2] for p in parts) / many for k in (0, 1))
        w = np.where(np.abs(z) <= o.l1, 0, -(z - np.sign(z) * o.l1) / ((o.beta + np.sqrt(n)) / o.alpha + o.l2))[:-1]
        model = fit(documents(spark, rows), marks(spark, labels), replace(o, shard_rows=60 // shards))
        assert np.allclose(model.dense(), w, atol=1e-9)
        assert model.constant == pytest.approx(-z[-1] / ((o.beta + math.sqrt(n[-1])) / o.alpha + o.l2))


def test_odd_rows(spark):
    rows, labels = corpus(200)
    odd = [(None, None), (None, "vile"), (5000, None), (5001, ""), (5002, "vile " * 300_000), (0, rows[0][1]), (5003, "\x00 \n")]
    marked = [*labels, (None, 1), (5000, 1), (5001, None), (7, 0), (7, 1), (9999, 1)]
    model = fit(documents(spark, rows + odd), marks(spark, marked))
    found = [(r.doc_id, r.score) for r in score(documents(spark, rows + odd), model).collect()]
    assert sorted(i for i, _ in found if i is not None) == sorted(i for i, _ in rows + odd if i is not None) and len(found) == 207
    assert all(0 <= s <= 1 for _, s in found)
    assert len({s for i, s in found if i in (5000, 5001, 5003)}) == 1


def test_equal_rows_count_once_and_spread_is_nothing(spark):
    rows, labels = corpus(120)
    o = Options(bits=12, shard_rows=40)
    one, two = fit(documents(spark, rows, 1), marks(spark, labels), o), fit(documents(spark, rows * 3, 5), marks(spark, labels * 2), o)
    assert one.slots.tolist() == two.slots.tolist() and one.weights.tolist() == two.weights.tolist() and one.constant == two.constant


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "a b")])
    for labels in ([], [(None, 1), (1, None), (2, 1)]):
        model = fit(docs, marks(spark, labels))
        assert model.constant is None and [tuple(r) for r in score(docs, model).collect()] == [(1, 0.0)]
    empty = documents(spark, [])
    assert fit(empty, marks(spark, [(1, 1)])).constant is None
    assert score(empty, Model(4, np.zeros(0, np.uint32), np.zeros(0), 0.0)).collect() == []


def test_labels_of_held_out_documents_are_not_used(spark, tmp_path):
    rows, labels = corpus(400)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    results = []
    for name, change in (("as they are", lambda i, y: y), ("turned", lambda i, y: 1 - y if i in held else y)):
        documents(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks(spark, [(i, change(i, y)) for i, y in labels]).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        results.append(sorted(map(tuple, op13_toxicity(spark, f"{tmp_path}/{name}").collect())))
    assert results[0] == results[1]
    assert {r[0] for r in results[0] if r[1]} == held
    assert all(r[3] == int(r[2] >= 0.3) for r in results[0])


@pytest.mark.parametrize("found", [[], [0], [5, 6, 70_000], [1, 2**18 - 1], list(range(0, 2**18, 97))])
def test_slots_are_read_as_written(found):
    from commitlens.llm import toxicity

    assert toxicity._read(toxicity._written(np.array(found, np.uint32))).tolist() == found
