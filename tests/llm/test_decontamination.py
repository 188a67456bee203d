import random
import re
from collections import Counter

from llm_helpers import docs_frame

from lamina.llm import decontamination
from lamina.llm.decontamination import decontaminate, find_leaks


def words(text):
    bare = (w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return [w.lower() for w in bare if w]


def shingles(w, size):
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute(docs, items):
    """Every (document, item) with some window at 0.8 or more."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            size = min(5, len(v))
            if not size:
                continue
            a = shingles(v, size)
            for p in range(len(w) - len(v) + 1):
                b = shingles(w[p : p + len(v)], size)
                weigh = lambda c: sum(n * sum(map(len, s)) for s, n in c.items())
                s = weigh(a & b) / weigh(a | b)
                if s >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), round(s, 9))
    return out


def corpus():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(12, 60)))) for k in range(30)] + [(90, "one two"), (91, ""), (92, None), (93, "!!! ??")]
    docs = []
    for k in range(120):
        item = list(items[k % 30][1].split())
        kind = k % 6
        if kind == 1:
            item[rng.randrange(len(item))] = "changed"
        if kind == 2:
            item = [w.upper() + "%%%" for w in item]
        if kind == 3:
            item = item[: len(item) // 2]
        if kind == 4:
            item = item[1:] + ["tail"]
        if kind == 5:
            item = []
        docs.append((k, " ".join(say(rng.randint(0, 80)) + item + say(rng.randint(0, 80)))))
    return [*docs, (200, "so One, two!"), (201, None), (202, ""), (203, "...")], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus()
    want = brute(docs, items)
    frame, bench = docs_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    for size in (64 << 20, 25_000):  # in one pass and in several
        monkeypatch.setattr(decontamination, "INDEX_BYTES", size)
        got = {}
        for r in find_leaks(frame, bench).collect():
            got[r.doc_id, r.item_id] = max(got.get((r.doc_id, r.item_id), 0), round(r.similarity, 9))
            assert r.last_word - r.first_word == len(words(dict(items)[r.item_id]))
        assert got == want
    kept = {r.doc_id for r in decontaminate(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_edges(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    long = "x " * 50_000 + "a b c d e f g h" + " y" * 10
    rows = [(None, "a b c d e f g h", 1), (5, long, 2), (5, long, 2)]
    frame = docs_frame(spark, rows, ", item_id int")
    got = sorted((r.doc_id or 0, r.first_word) for r in find_leaks(frame, bench).collect())
    assert got == [(0, 0), (5, 50_000), (5, 50_000)]
    assert decontaminate(frame, bench).columns == frame.columns
    assert find_leaks(docs_frame(spark, []), bench).count() == 0
    assert find_leaks(frame, bench.limit(0)).count() == 0


def test_documents_shorter_than_items_against_brute_force(spark):
    _, items = corpus()
    docs = []
    for _, text in items[:30]:
        w = text.split()
        for some in (w[:-1], w[1:], w[:-2], w[2:-1], w[: len(w) * 3 // 4], w[: len(w) // 2], w[:5], w[:4]):
            docs.append((len(docs), " ".join(some)))
    docs += [(900, "one"), (901, "two one"), (902, "...")]
    want = brute(docs, items)
    for d, text in docs:
        for i, item in items:
            w, v = words(text), words(item)
            if 5 <= len(w) < len(v):  # the whole document is the one window
                a, b = shingles(v, 5), shingles(w, 5)
                weigh = lambda c: sum(n * sum(map(len, s)) for s, n in c.items())
                s = weigh(a & b) / weigh(a | b)
                if s >= 0.8:
                    want[d, i] = round(s, 9)
    frame, bench = docs_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    rows = find_leaks(frame, bench).collect()
    assert len(want) > 60 and {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == want
    assert all((r.first_word, r.last_word) == (0, len(words(docs[r.doc_id][1]))) for r in rows)
    assert {r.doc_id for r in decontaminate(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_similar_windows_beyond_the_radius():
    """Of windows whose similarity to an item is just enough, hardly any lies beyond the radius,
    and the index finds all within it."""
    import numpy as np

    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 10))) for _ in range(3000)]
    hashes = decontamination._Words()
    items, prints, near, far, counts = [], [], 0, 0, []
    for k in range(150):
        item = rng.choices(vocab, k=rng.randint(20, 90))
        words = decontamination.words_of(" ".join(item).encode(), hashes)
        items.append((k, *decontamination.shingles_of(words, 5)))
        for _ in range(40):
            w, some = list(item), rng.randint(1, 2)
            for at in rng.sample(range(len(w)), some):
                w[at] = rng.choice(vocab)
            h, weight = decontamination.shingles_of(decontamination.words_of(" ".join(w).encode(), hashes), 5)
            s = decontamination.similarity(h, weight, *items[-1][1:])
            if 0.8 <= s <= 0.85:
                p = decontamination._pack((decontamination._signs(h) * weight[:, None]).sum(axis=0)[None])
                prints.append((k, p[0]))
    group = decontamination._Group(0, 5, items)
    for k, p in prints:
        distance = int(np.bitwise_count(p ^ group.prints[k]))
        counts.append(distance)
        found = set(group.candidates(np.array([p]))[1].tolist())
        assert found == {i for i, q in enumerate(group.prints) if np.bitwise_count(p ^ q) <= decontamination.RADIUS}
        far += distance > decontamination.RADIUS
    print(f"{len(counts)} windows at 0.80 to 0.85: {np.mean(counts):.1f} bits apart on average, {max(counts)} at most, {far} beyond the radius")
    assert len(counts) > 300 and far == 0


def test_index_keeps_its_bound():
    """The cost that _passes() reckons with is no less than the index's own bytes."""
    import pickle

    rng = random.Random(1)
    items = [(k, " ".join(rng.choices(["a", "bc", "def", "g"], k=rng.randint(5, 40))).encode()) for k in range(2000)]
    index = decontamination.Index(items, 5)
    cost = sum(decontamination._ITEM_COST + decontamination._BYTE_COST * len(t) for _, t in items)
    held = sum(g.prints.nbytes + sum(a.nbytes + b.nbytes for a, b in g.lists) + sum(h.nbytes + w.nbytes for _, h, w in g.items) for g in index.groups) + sum(x.nbytes for x in index.known.values())
    groups = len(index.groups)
    assert held - groups * 8 * 257 * 4 <= cost and len(pickle.dumps(index)) <= 3 * cost + sum(x.nbytes for x in index.screen.values()) + groups * 9000
