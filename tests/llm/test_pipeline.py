from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from commitlens.llm import quality, simhash
from commitlens.llm.common import stored
from test_lines import brute
from test_mixing import brute_targets, words


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before each stage, and what the last returns."""
    sf_dir = "/root/testdata/sf0.001"
    tables = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf_dir), "test-stage"))
    return tables


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing",
    ]
    assert all(t.schema == stages[0].schema for t in stages[:5])


def test_rejected_documents_go(stages):
    kept = {r.doc_id for r in quality.classify(stages[0]).filter("accepted").collect()}
    assert Counter(rows(stages[1])) == Counter((i, t) for i, t in rows(stages[0]) if i in kept)
    assert 0 < len(kept) < stages[0].count()


def test_lines_go(stages):
    before = rows(stages[1])
    assert Counter(rows(stages[2])) == Counter((i, kept) for (i, _), (kept, _, _) in zip(before, brute(before), strict=True))


def test_one_document_of_each_group_stays(stages):
    before = rows(stages[2])
    prints = [simhash.fingerprint((t or "").encode(), 4) for _, t in before]
    label = list(range(len(before)))
    for _ in range(len(before)):
        changed = False
        for i in range(len(before)):
            for j in range(i):
                if label[i] != label[j] and (prints[i] ^ prints[j]).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
        if not changed:
            break
    least = {}
    for (i, _), root in zip(before, label, strict=True):
        least[root] = min(i, least.get(root, i))
    assert {i for i, _ in rows(stages[3])} == set(least.values())


def test_sources_come_near_their_targets(stages):
    before, after = stages[3].collect(), stages[4].collect()
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in before:
        sizes[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    for r in after:
        taken[r.source] += words(r.text)
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= largest[source] + 1
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}


def test_sequences_hold_all_documents(stages, vocabulary):
    tokenizer = Tokenizer.from_file(vocabulary)
    texts = rows(stages[4])
    pieces = stages[5].collect()
    held = defaultdict(list)
    for r in pieces:
        assert len(r.ids) == 4 * r.length
        held[r.sequence_id].append((r.offset, r.length))
    total = 0
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(held) <= -(-total // 2048) + 2
    found = Counter((r.doc_id, r.start, r.ids) for r in pieces)
    want = Counter()
    for i, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            want[i, a, ids[a:b].tobytes()] += 1
    assert found == want


def test_run_is_the_stages_one_after_the_other(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    key = ["doc_id", "piece", "ids_crc32"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, stages[5].select(*key).collect()))
    assert got.agg(F.countDistinct("sequence_id")).first()[0] == stages[5].agg(F.countDistinct("sequence_id")).first()[0]
