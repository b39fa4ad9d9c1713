import re
from collections import defaultdict

import pytest

from commitlens.llm.lines import LineIndex, batch_bounds, keys_by_batch, line_dedup, line_keys

BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_chars=10):
    """Kept text, lines and dropped lines of each row, by a dictionary of all keys."""
    last = (1 << 63) - 1
    holders = defaultdict(set)
    split = [((last if i is None else i), (t or "").split("\n")) for i, t in rows]
    for i, lines in split:
        for line in lines:
            holders[lower(line.strip(BLANKS))].add(i)
    out = []
    for i, lines in split:
        kept = [x for x in lines if len(lower(x.strip(BLANKS))) < min_chars or min(holders[lower(x.strip(BLANKS))]) == i]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


ROWS = [
    (5, "a line that repeats\nÉcole des Beaux Arts\nshort\nown line of five"),
    (3, "  A LINE THAT REPEATS \t\nshort\n\n"),
    (9, "a line that repeats"),
    (9, "éCOLE DES BEAUX ARTS\na line that repeats"),
    (7, "École des Beaux ARTS\nÉcole des Beaux Arts"),
    (None, "own line of five\nnobody else has this"),
    (None, "nobody else has this"),
    (11, None),
    (12, ""),
    (13, "x" * 50_000 + "\n" + "x" * 50_000),
    (14, "x" * 50_000),
    (15, "0123456789\n012345678\n0123456789"),
    (16, "0123456789\n012345678"),
    (16, "0123456789\n012345678"),
    (-4, "\ttrailing feed line\r"),
    (17, "trailing feed line"),
]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (7, 3)])
def test_equals_brute_force(documents, batches, fanout):
    got = line_dedup(documents(*ROWS), batches=batches, fanout=fanout).collect()
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_lines, r.n_dropped) for r in got)
    want = sorted((i is None, i or 0, *kept) for (i, _), kept in zip(ROWS, brute(ROWS), strict=True))
    assert found == want


def test_keeps_other_columns_and_follows_the_text(documents, clashing):
    docs = clashing(documents(*ROWS))
    got = line_dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    for r in got.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
        assert r.key == "x"


def test_empty_table(documents):
    assert line_dedup(documents()).collect() == []


def test_runs_are_levelled_and_disjoint(spark, documents):
    index = LineIndex(spark, buckets=3, fanout=2)
    for batch in range(5):
        rows = [(batch * 10 + i, f"line number {j} of all") for i, j in enumerate(range(batch, batch + 4))]
        index.add(line_keys(documents(*rows), 10, "doc_id", "text"))
    assert [len(level) for level in index.levels] == [1, 0, 1]
    rows = index.holders().collect()
    assert len(rows) == len({bytes(r.key) for r in rows}) == 8


def test_a_line_of_a_third_of_all_documents(documents):
    rows = [(i, "the same long line everywhere\n" + f"line of {i // 3}, long enough") for i in range(900)]
    got = {r.doc_id: r for r in line_dedup(documents(*rows)).collect()}
    assert got[0].n_dropped == 0 and got[1].n_dropped == 2 and got[3].n_dropped == 1


def test_no_python_in_the_plan(documents, capsys):
    line_dedup(documents(*ROWS)).explain()
    assert "Python" not in capsys.readouterr().out


def test_a_batch_reads_only_its_own_keys(documents):
    docs = documents(*[(i, f"line number {i}\nand another one {i % 3}") for i in range(60)])
    bounds = batch_bounds(docs, 6, "doc_id")
    keys, number = keys_by_batch(line_keys(docs, 10, "doc_id", "text"), bounds)
    assert number == len(bounds) + 1 == 6
    held = [{r.holder for r in keys.filter(f"batch = {b}").collect()} for b in range(number)]
    assert sorted(sum(map(list, held), [])) == list(range(60))
    assert all(max(a) < min(b) for a, b in zip(held, held[1:], strict=False))
    for b in range(number):
        plan = keys.filter(f"batch = {b}")._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"PartitionFilters: \[[^\]]*batch#\d+ = {b}\)", plan)
