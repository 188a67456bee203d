import random
import zlib

import pytest
from llm_helpers import docs_frame

from lamina.llm import periodic_runs
from lamina.llm.queries import planted
from lamina.llm.periodic_runs import find_runs, scan, word_ids, words_of


def slow_runs(w, min_length=12, min_exponent=2):
    """Every stretch, its smallest period by definition, and whether a neighbour extends it."""
    n, out = len(w), []
    for s in range(n):
        for e in range(s + min_length, n + 1):
            q = next(p for p in range(1, e - s + 1) if all(w[i] == w[i + p] for i in range(s, e - p)))
            if e - s >= min_exponent * q and not (s and w[s - 1] == w[s - 1 + q]) and not (e < n and w[e] == w[e - q]):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_collapse(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def some_texts():
    rng = random.Random(5)
    texts = ["", None, " \n\t ", "a", "a " * 11, "a " * 12, "a b " * 6, "x " + "a b c " * 4 + "a y", "\x1c\xa0 b" * 14, "é 日 " * 9]
    for k in range(60):
        w = [rng.choice("abc"[: 1 + k % 3]) for _ in range(rng.randrange(50))]
        if k % 2:
            a = rng.randrange(len(w) + 1)
            w[a:a] = [rng.choice("xyz") for _ in range(rng.randrange(1, 9))] * rng.randrange(2, 5)
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(w))
    return texts


def check(spark, rows, **how):
    got = find_runs(docs_frame(spark, rows, ", runs string"), **how).collect()
    assert len(got) == len(rows)
    want = []
    for d, t, _ in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        runs = slow_runs(w, **how)
        want.append(repr((d, len(w), runs, slow_collapse(w, runs))))
    assert sorted(repr((r.doc_id, r.n_words, [tuple(x) for x in r.runs_], r.collapsed)) for r in got) == sorted(want)


def test_against_the_definition(spark):
    rows = [(i, t, "x") for i, t in enumerate(some_texts())] + [(None, "a b " * 8, "x"), (7, "a b " * 8, "x"), (7, "a b " * 8, "x")]
    check(spark, rows)
    check(spark, rows[:40], min_length=5, min_exponent=3)


def test_ranges_of_lags(spark, monkeypatch):
    """The way of long texts, for all that are not empty."""
    monkeypatch.setattr(periodic_runs, "LONG_BYTES", 0)
    monkeypatch.setattr(periodic_runs, "LAGS", 3)
    texts = some_texts()
    check(spark, [(i % 50, t, "x") for i, t in enumerate(texts + texts[:12])])


def test_a_long_text(spark):
    rng = random.Random(8)
    w = [f"w{rng.randrange(10**6)}" for _ in range(6_000)]
    w[3_000:3_000] = w[100:1_300] * 2
    w[7_000:7_000] = ["z"] * 40
    text = " ".join(w)
    ids = word_ids(words_of(text))
    runs = {}
    for q in range(1, len(w) // 2 + 1):  # one shift after another
        run = 0
        for i in [*(j for j in (ids[q:] != ids[:-q]).nonzero()[0]), len(w) - q]:
            if i - run >= max(12 - q, q):
                runs.setdefault((int(run), int(i - run + q)), q)
            run = i + 1
    assert scan(ids, 1, len(w), 12, 2) == runs and any(q == 1_200 for q in runs.values())
    got = find_runs(docs_frame(spark, [(1, text), (2, text), (3, "a " * 20)])).collect()
    want = sorted((s, n, q) for (s, n), q in runs.items())
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in got} == {1: want, 2: want, 3: [(0, 20, 1)]}


def test_planted(spark):
    rows = [(i, t) for i, t in enumerate(some_texts() * 4)] + [(None, "a b")]
    got = {r.doc_id: r.text for r in planted(docs_frame(spark, rows)).collect()}
    changed = 0
    for d, t in rows:
        h, w = (1 if d is None else zlib.crc32(str(d).encode())), (t or "").encode().split()
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got[d].encode().split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        else:
            assert got[d] == (t or "")
    assert changed > 10


def test_bounds(spark):
    assert find_runs(docs_frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        find_runs(docs_frame(spark, []), min_exponent=1)
