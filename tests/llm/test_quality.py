from collections import Counter

import numpy as np
import pytest

from commitlens.llm import quality


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_agrees_with_labels_it_never_saw(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("quality", "label")
    rows = quality.classify(docs, model).join(labels, "doc_id").collect()
    good = [r.accepted for r in rows if r.label == 1]
    bad = [r.accepted for r in rows if r.label == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05
    assert model.documents == docs.count()


def test_a_bounded_sample_is_enough(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = quality.classify(docs, sample_rows=400).collect()
    right = [r.accepted == bool(labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert np.mean(right) > 0.95


def test_special_rows(documents, clashing, model):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (None, "A sentence of plain words."), (5, "x " * 60_000), (6, "a" * 3_000_000), (6, "a" * 3_000_000)]
    docs = clashing(documents(*rows))
    got = quality.classify(docs, model)
    assert got.columns == [*docs.columns, "quality", "accepted"]
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == 7 and all(found[i].quality == 0.0 and not found[i].accepted for i in (1, 2, 3))
    assert found[None].accepted and not found[5].accepted
    assert quality.classify(got, model).columns == got.columns


def test_empty_table(documents):
    assert quality.classify(documents()).collect() == []


def test_measures_of_parts_equal_those_of_the_whole(monkeypatch):
    text = ("Some words, some MORE words!\n#### 1234 | words words\n" * 50 + "last line").encode()
    whole = quality.measure(text)
    parts = quality.text_parts
    monkeypatch.setattr(quality, "text_parts", lambda t: parts(t, 40))
    assert quality.measure(text) == whole
    assert whole.words == len(text.split()) and sum(whole.shapes.values()) == whole.words


def test_accuracies_are_recovered():
    """Votes drawn from known accuracies, independently; the model sees no class."""
    rng = np.random.default_rng(3)
    n = len(quality.LABELLERS)
    right = rng.uniform(0.7, 0.95, n)
    truth = rng.random(30_000) < 0.6
    voted = rng.random((len(truth), n)) < 0.8
    correct = rng.random((len(truth), n)) < right
    cast = np.where(voted, np.where(correct, truth[:, None], ~truth[:, None]).astype(int), quality.NO_VOTE)
    patterns = (cast * 3 ** np.arange(n)).sum(1)
    prior, table, posterior = quality.accuracies(Counter(patterns.tolist()))
    assert prior == pytest.approx(0.6, abs=0.02)
    assert table[quality.GOOD, :, quality.GOOD_VOTE] == pytest.approx(right, abs=0.03)
    assert table[quality.BAD, :, quality.BAD_VOTE] == pytest.approx(right, abs=0.03)
    guessed = np.array([posterior[p] for p in patterns.tolist()]) > 0.5
    assert (guessed == truth).mean() > 0.95


def test_scorer_learns_soft_labels():
    rows = [(np.array([i % 5, 100]), np.array([1.0, 0.5])) for i in range(200)]
    target = np.array([0.95 if i % 5 < 2 else 0.05 for i in range(200)])
    weights, bias = quality.train(rows, target)
    guessed = np.array([values @ weights[slots] + bias for slots, values in rows])
    assert ((guessed > 0) == (target > 0.5)).all()


def test_shapes_that_differ_late_are_features_of_their_own():
    common = "a1" * 40
    found = [quality.features(quality.measure(f"{common}{end}".encode()))[0][0] for end in ("", "#", "#A")]
    assert len(set(found)) == 3
