import random
import re

import numpy as np
import pytest
from llm_helpers import docs_frame

from lamina.llm import near_dedup
from lamina.llm.common import WordHashes
from lamina.llm.near_dedup import estimate, near_duplicates, sketch
from lamina.llm.shingles import shingle_set


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, k = [], 0
    for _ in range(25):
        base = say(rng.randint(3, 120))
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((rng.randrange(10**6) * 1000 + k, " ".join(w) if rng.random() < 0.7 else "\t".join(w).upper()))
            k += 1
    passage = say(30)
    rows += [(10**10 + i, " ".join([*say(20), *passage, *say(20)])) for i in range(30)]
    chain = say(60)
    for i in range(12):  # each close to the next, the ends far apart
        chain = chain[:]
        chain[(5 * i) % 60] = f"step{i}"
        rows.append((2 * 10**10 + i, " ".join(chain)))
    return [*rows, (3, ""), (5, None), (7, " \n"), (8, "word"), (9, "Word"), (11, "one two"), (12, "ONE  two")]


@pytest.mark.parametrize(("size", "block", "pairs"), [(2, 256, 200), (5, 256, 200), (2, 4, 200), (2, 3, 0)])
def test_against_brute_force(spark, monkeypatch, size, block, pairs):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PAIRS", pairs)  # 0: more rounds of pivots
    rows = corpus(size)
    got = near_duplicates(docs_frame(spark, [(*r, "x") for r in rows], ", kept string"), size, 80)
    assert got.columns == ["doc_id", "text", "kept", "n_shingles", "component_id", "kept_"]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept_) for r in got.collect()} == brute(rows, size)


def test_odd_rows(spark):
    text = "a b c d e f g"
    rows = [(None, text), (4, text), (4, text), (4, "quite another text of it"), (6, "quite another text of it"), (9, "long " * 60_000)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs_frame(spark, rows), 2).collect()), key=str)
    assert got == sorted([(None, None, True), (4, 4, True), (4, 4, True), (4, 4, True), (6, 4, False), (9, 9, True)], key=str)
    assert near_duplicates(docs_frame(spark, []), 2).collect() == []


def test_texts_of_one_id_are_one_document(spark):
    a, b = "one two three four five six", "quite another text of that document"
    rows = [(4, a), (4, b), (3, b), (7, a), (9, "nothing like them at all here")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs_frame(spark, rows), 2).collect())
    assert got == [(3, 3, True), (4, 3, False), (4, 3, False), (7, 3, False), (9, 9, True)]


def test_one_large_group(spark):
    """A third of all rows are copies of one text, another third near copies of it."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 600):
        w = list(base)
        w[rng.randrange(60)] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(f"x{i}y{k}" for k in range(30))) for i in range(600, 900)] + [(1000 + i, "") for i in range(300)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs_frame(spark, rows), 2).collect()}
    assert got == brute(rows, 2)


def test_estimates():
    rng, priority = np.random.default_rng(1), near_dedup._priorities()
    for n in (3, 20, 150, 2000):
        errors = []
        for _ in range(40):
            u = rng.integers(0, 2**63, n * 10 // 8 + 1, dtype=np.uint64)
            k = max(1, len(u) // 10)
            a, b = u[k:], u[:-k]
            true = (len(u) - 2 * k) / len(u)
            same = (sketch(a, priority) == sketch(b, priority)).mean()
            errors.append(estimate(same, len(a), len(b)) - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_shingles():
    h = WordHashes()
    assert len(shingle_set(b"a b c", 5, h)) == 1 and len(shingle_set(b"", 5, h)) == 0
    assert (shingle_set(b"A  b\nC d", 2, h) == shingle_set(b"a b c\x0bD", 2, h)).all()
