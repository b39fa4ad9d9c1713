"""The quality classifier against a plain recomputation, word by word and vote by vote."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from commitlens.llm import quality as q

BLANK = " \t\n\x0b\x0c\r"


def shape(word):
    out = []
    for sign in word:
        for byte in sign.encode():
            c = chr(byte)
            out.append("a" if byte >= 128 or "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "9" if "0" <= c <= "9" else c)
    return "".join(out)


def plain_measures(text):
    words = [w for w in re.split(f"[{BLANK}]", text) if w]
    visible = "".join(words)
    n, size = max(len(words), 1), max(len(visible.encode()), 1)
    windows = [words[i : i + 1000] for i in range(0, len(words), 1000)]
    before = ["", *words[:-1]][: len(words)]
    if len(windows) > 1 and len(windows[-1]) < 500:
        windows.pop()
    among = max(sum(map(len, windows)), 1)
    pairs = vocabulary = 0.0
    for w in windows:
        pairs += len(w) - len({(a, b) if a != b else None for a, b in zip([0, *w[:-1]], w, strict=True)})
        vocabulary += len(w) * (1 - min(1.0, len(set(w)) / len(w) ** 0.75))
    odd = [sum(c not in "aA9.,;:'\"-?()" for c in shape(w)) for w in words]
    letters = sum(c in "aA" for w in words for c in shape(w))
    wide = sum("　" <= c <= "\udfff" for c in visible)
    lines = text.split("\n")
    return len(words), {
        "repeated_words": sum(a == b for a, b in zip(before, words, strict=True)) / n,
        "repeated_pairs": pairs / among,
        "repeated_vocabulary": vocabulary / among,
        "symbols": sum(odd) / size,
        "symbol_words": sum(o == len(shape(w)) for o, w in zip(odd, words, strict=True)) / n,
        "marked_words": sum(o > 0 for o in odd) / n,
        "capitals": sum("A" <= c <= "Z" for c in visible) / max(letters, 1),
        "exclamations": text.count("!") / n,
        "digits": sum("0" <= c <= "9" for c in visible) / size,
        "repeated_lines": 1 - len(set(lines)) / len(lines),
        "word_length": 0.55 if 2 * wide > len(visible) else min(1.0, abs(math.log(max(len(visible) / n, 0.1) / 5.5))),
    }


def plain_votes(words, values):
    out = []
    for name, least, good, bad in q.LABELLERS:
        out.append(2 if words < least else 1 if values[name] < good else 0 if values[name] > bad else 2)
    return out


def texts(n=200, seed=1):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(500)]
    out = ["", " \n", "word", "ÉCOLE école", "語" * 300 + "。" + " 語" * 20, "привет мир " * 3]
    while len(out) < n:
        words = rnd.choices(vocabulary, k=rnd.choice([3, 30, 300, 1400, 2600]))
        kind = rnd.randrange(6)
        if kind == 1:
            words = [w + "$$$" for w in words]
        if kind == 2:
            words = [w.upper() + "!!" for w in words]
        if kind == 3:
            words = [rnd.choice(words[:3]) for _ in words]
        if kind == 4:
            words = [str(rnd.randrange(10**6)) if rnd.random() < 0.7 else w for w in words]
        out.append("".join(w + rnd.choice([" "] * 9 + ["\n", ". "]) for w in words))
    return out


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_measures_and_votes(monkeypatch, part):
    whole = q.text_parts
    monkeypatch.setattr(q, "text_parts", lambda text: whole(text, part))
    for text in texts():
        found = q.measure(text.encode())
        words, values = plain_measures(text)
        assert found.words == words
        assert {k: float(v) for k, v in found.values.items()} == pytest.approx(values, abs=1e-12), text[:60]
        assert q.votes(found) == plain_votes(words, values)


def plain_accuracies(cast, rounds=100):
    """Expectation-maximisation document by document."""
    posterior = [0.02 if 0 in c else 0.98 for c in cast]
    labellers = len(cast[0])
    for _ in range(rounds):
        table = [[[2.5 if (v == 0) == (k == q.BAD) else 0.5 for v in (0, 1)] for _ in range(labellers)] for k in (0, 1)]
        for c, p in zip(cast, posterior, strict=True):
            for j, v in enumerate(c):
                if v < 2:
                    table[q.GOOD][j][v] += p
                    table[q.BAD][j][v] += 1 - p
        table = [[[x / sum(pair) for x in pair] for pair in rows] for rows in table]
        prior = (sum(posterior) + 1) / (len(cast) + 2)
        new = []
        for c in cast:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[q.GOOD][j][v] / table[q.BAD][j][v]) for j, v in enumerate(c) if v < 2)
            new.append(1 / (1 + math.exp(-odds)))
        moved = max(abs(a - b) for a, b in zip(new, posterior, strict=True))
        if moved < 1e-9:
            break
        posterior = new
    return prior, np.array(table), posterior


def plain_scorer(described, target, rounds=300, decay=1e-4):
    """Logistic regression on a dense matrix, by the same accelerated steps."""
    x = np.zeros((len(described), q.SLOTS))
    for i, (slots, values) in enumerate(described):
        for s, v in zip(slots, values, strict=True):
            x[i, s] += v
    target = np.array(target)
    each = (1 - target) / (2 * max((1 - target).sum(), 1e-3)) + target / (2 * max(target.sum(), 1e-3))
    old = new = np.zeros(q.SLOTS + 1)
    ahead = new
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(x @ ahead[:-1] + ahead[-1])))
        error = each * (p - target)
        slope = np.append(x.T @ error + decay * ahead[:-1], error.sum())
        old, new = new, ahead - 0.5 * slope
        ahead = new + (t - 1) / (t + 2) * (new - old)
    return 1 / (1 + np.exp(-(x @ new[:-1] + new[-1])))


def plain_features(text):
    words, values = plain_measures(text)
    total = {}
    for w in [w for w in re.split(f"[{BLANK}]", text) if w]:
        run = re.sub(r"(.)\1+", r"\1\1", shape(w))
        slot = zlib.crc32(run.encode("latin-1")) % q.SLOTS
        total[slot] = total.get(slot, 0) + 1
    slots, weights = list(total), [(n / max(words, 1)) ** 0.5 for n in total.values()]
    for name, value in values.items():
        for step in range(int(min(value, 2.0) * 10) + 1):
            slots.append(zlib.crc32(f"{name}:{step}".encode()) % q.SLOTS)
            weights.append(0.5)
    return slots, weights


def test_whole_classifier(spark, documents):
    rows = texts()
    found = {r.doc_id: r for r in q.classify(documents(*enumerate(rows))).collect()}
    prior, table, posterior = plain_accuracies([plain_votes(*plain_measures(t)) for t in rows])
    model = q.fit(documents(*enumerate(rows)))
    assert model.prior == pytest.approx(prior, abs=1e-6) and model.table == pytest.approx(table, abs=1e-6)
    want = plain_scorer([plain_features(t) for t in rows], posterior)
    for i, text in enumerate(rows):
        score = want[i] if text.strip(BLANK) else 0.0
        assert found[i].quality == pytest.approx(score, abs=1e-6)
        assert found[i].accepted == (found[i].quality >= 0.5)


def test_clean_texts_of_any_length_and_script():
    rnd = random.Random(2)
    latin, russian = ([[chr(first + rnd.randrange(many)) for _ in range(rnd.randint(2, 11))] for _ in range(20_000)] for first, many in ((97, 26), (0x430, 32)))
    for words in (latin, russian):
        weights = [1 / (i + 1) for i in range(len(words))]
        for n in (400, 200_000):
            text = " ".join("".join(w) + ("." if rnd.random() < 0.07 else "") for w in rnd.choices(words, weights, k=n))
            assert q.BAD_VOTE not in q.votes(q.measure(text.encode()))
    chinese = "".join(chr(rnd.randint(0x4E00, 0x6E00)) + ("，" if rnd.random() < 0.07 else "。 " if rnd.random() < 0.03 else "") for _ in range(6000))
    assert q.BAD_VOTE not in q.votes(q.measure(chinese.encode()))


def test_threshold_is_accepted(documents):
    rows = list(enumerate(texts(40)))
    model = q.fit(documents(*rows))
    scores = {r.doc_id: r.quality for r in q.classify(documents(*rows), model).collect()}
    least = sorted(scores.values())[20]
    found = q.classify(documents(*rows), model, least=least).collect()
    assert all(r.accepted == (r.quality >= least) for r in found) and any(r.quality == least and r.accepted for r in found)
