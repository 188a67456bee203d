import random
import zlib

import numpy as np
from llm_helpers import docs_frame

from lamina.llm.boosting import BoostedTrees, Isotonic
from lamina.llm.toxicity import INSULTS, Words, features, reject_toxic, score_toxicity


def data():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("aeioumnrst", k=rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice([*INSULTS[:12], "1d10t", "m.o.r.o.n"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = data()
    extra = [(5000, None), (5001, ""), (5002, "   "), (None, "you idiot"), (5003, "plain words " * 40_000), (3, rows[3][1])]
    frame = docs_frame(spark, [(*r, "s") for r in rows + extra], ", score string")
    label_frame = spark.createDataFrame([*labels, (7, None), (8, 9), (None, 1)], "doc_id long, toxic int")
    got = score_toxicity(frame, label_frame).collect()
    assert len(got) == len(rows) + len(extra) and got[0].asDict().keys() == {"doc_id", "text", "score", "score_", "held_out", "predicted"}
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score_ <= 1 and r.predicted == (r.score_ >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add(r.score_)
    assert all(len(s) == 1 for s in by_text.values())
    kept = reject_toxic(frame, label_frame)
    assert kept.columns == frame.columns and {r.doc_id for r in got if not r.predicted} == {r.doc_id for r in kept.collect()}


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = data()
    frame = docs_frame(spark, rows)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a, b = ({r.doc_id: r.score for r in score_toxicity(frame, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_no_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in score_toxicity(docs_frame(spark, [(1, "a")]), none).collect()] == [0.0]
    assert score_toxicity(docs_frame(spark, []), none).count() == 0


def slow_features(text, learned):
    """The features of a text, word by word."""
    from math import log1p

    from lamina.llm.toxicity import SECOND_PERSON

    marks, look = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", dict(zip("013457@$!|", "oieastasii", strict=True))
    words = text.split()
    if not words:
        return [0.0] * 21
    rows = []
    for w in words:
        plain = w.lower().strip(marks)
        undone = "".join(c for c in (look.get(c, c) for c in w.lower()) if "a" <= c <= "z")
        insult, hidden = plain in INSULTS, plain not in INSULTS and undone in INSULTS and undone != plain
        weight = learned.get(plain, learned.get(undone) if undone != plain else None)
        inner = any(a.isalpha() and not b.isalpha() and any(c.isalpha() for c in w.lower()[k + 2 :]) for k, (a, b) in enumerate(zip(w.lower(), w.lower()[1:])))
        rows.append((insult, hidden, plain in SECOND_PERSON, weight or 0.0, weight is not None, len(plain) > 1 and plain.isalpha() and w.isupper(), any(c.isdigit() for c in plain) and any("a" <= c <= "z" for c in plain), inner, len(plain) == 1))
    n, total = len(rows), [sum(r[k] for r in rows) for k in range(9)]
    bad = [k for k, r in enumerate(rows) if r[0] or r[1] or r[3] > 0]
    you = [k for k, r in enumerate(rows) if r[2]]
    near = sum(any(b - 5 <= y <= b + 5 for y in you) for b in bad)
    size = len(text)
    capitals, small = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    return [log1p(n), *(100 * t / n for t in total), log1p(total[0] + total[1]), log1p(total[4]), log1p(total[2]), max(r[3] for r in rows), log1p(near) if bad else 0, 100 * near / n if bad else 0, max((sum(b <= c < b + 50 for c in bad) for b in bad), default=0), 100 * capitals / max(1, capitals + small), 1000 * text.count("!") / size, 1000 * text.count("?") / size, 100 * sum(c in marks[1:15] + marks[15:20] + marks[22:28] for c in text) / size]


def test_features_against_a_slow_reference():
    rng = random.Random(4)
    learned = {"awful": 2.5, "nice": -1.0, "idot": 1.5}
    pool = ["idiot", "1d10t", "m.o.r.o.n", "You", "your,", "awful", "a.w.f.u.l", "nice!", "plain", "WORDS", "A", "b2b", "x-y", "!!!", "id0t", "U", "STUPID", "st-upid?", "12", "ok"]
    for _ in range(200):
        text = " ".join(rng.choices(pool, k=rng.randint(0, 90)))
        got = features(text.encode(), Words({k.encode(): v for k, v in learned.items()}))
        assert np.allclose(got, slow_features(text, learned), rtol=1e-5), text


def test_training_texts_are_bounded(spark, monkeypatch):
    """An id that repeats with many texts is learned from once."""
    from lamina.llm import toxicity

    seen, plain = [], toxicity.Calibrated
    monkeypatch.setattr(toxicity, "Calibrated", lambda x, y: seen.append(len(y)) or plain(x, y))
    rows, labels = data()
    rows += [(i, f"{t} again {k}") for i, t in rows[:5] for k in range(20)]
    score_toxicity(docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), train_rows=300)
    assert seen == [300]


def test_features():
    w = Words({})
    assert not features(b"", w).any() and not features(b" \n", w).any()
    assert features(b"YOU are an id1ot, idiot", w)[14] > 0
    long = features(b"word " * 200_000, w)
    assert np.isfinite(long).all()


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees(60, 3).fit(x, y).margin(x)
    assert ((m > 0) == y).mean() > 0.97
    iso = Isotonic(m + rng.normal(size=2000), y)
    p = iso(np.linspace(-5, 5, 200))
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1
