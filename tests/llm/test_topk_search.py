import numpy as np
import pytest

from lamina.llm import topk_search
from lamina.llm.topk_search import top_k


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        if q is None or not v or None in v:
            continue
        s = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i is not None and w and None not in w and len(w) == len(v) and i != q)
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vector array<long>, score string")


@pytest.mark.parametrize("kind", ["skewed lengths", "near copies", "negative"])
def test_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(topk_search, "BUCKET", 64)
    monkeypatch.setattr(topk_search, "QUERIES", 7)
    monkeypatch.setattr(topk_search, "STRIDE", 200)
    monkeypatch.setattr(topk_search, "SIDE", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    if kind == "skewed lengths":
        x *= rng.lognormal(0, 1.5, size=(600, 1))
    if kind == "near copies":
        x = x[rng.integers(0, 9, 600)] + rng.normal(size=(600, 8)) * 0.02
    if kind == "negative":
        x = np.abs(x) * np.where(np.arange(600) % 20 == 0, -1, 1)[:, None]
    rows = [(i, [int(c) for c in np.floor(64 * v)]) for i, v in enumerate(x)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, [0] * 8), (903, [1, 2]), (904, None), (905, [1, None, 3, 4, 5, 6, 7, 8]), (None, rows[1][1])]
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0] + [(903, [1, 2]), (902, [0] * 8)]
    got = top_k(frame(spark, [(*r, "") for r in rows]), frame(spark, [(*r, "") for r in queries]), 20)
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, 20)


def test_short_buckets_are_not_sent(spark, monkeypatch):
    """Pairs of block and bucket: where lengths differ, few of all possible ones travel, and nothing is lost."""
    monkeypatch.setattr(topk_search, "BUCKET", 64)
    monkeypatch.setattr(topk_search, "QUERIES", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3_000, 8)) * rng.lognormal(0, 1.0, size=(3_000, 1))
    rows = [(i, [int(c) for c in np.floor(64 * v)]) for i, v in enumerate(x)]
    queries, counts = rows[::20], {}
    got = top_k(frame(spark, [(*r, "") for r in rows]), frame(spark, [(*r, "") for r in queries]), 20, counts=counts)
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, 20)
    assert counts["possible"] >= 10 * 47 and counts["sent"] < 0.4 * counts["possible"], counts


def test_few_many_and_huge(spark):
    rows = [(1, [2**40, -5]), (2, [2**40, 7]), (3, [3, 4]), (3, [3, 4])]
    got = sorted(map(tuple, top_k(frame(spark, [(*r, "") for r in rows]), frame(spark, [(1, [2**40, -5], ""), (3, [3, 4], "")]), 5).collect()))
    cap = 2**63 - 1
    assert got == [(1, 1, 2, cap), (1, 2, 3, 3 * 2**40 - 20), (1, 3, 3, 3 * 2**40 - 20), (3, 1, 2, 3 * 2**40 + 28), (3, 2, 1, 3 * 2**40 - 20)]
    none = frame(spark, [])
    assert top_k(none, none).count() == 0
    assert top_k(frame(spark, [(1, [1], "")]), frame(spark, [(1, [1], "")])).count() == 0


def test_more_queries_than_a_block_and_narrow_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERIES", 5)
    monkeypatch.setattr(topk_search, "BUCKET", 16)
    rng = np.random.default_rng(7)
    for high in (100, 30_000, 2**31 + 5):
        rows = [(i, [int(x) for x in rng.integers(-high, high, 3)]) for i in range(120)]
        got = top_k(frame(spark, [(*r, "") for r in rows]), frame(spark, [(*r, "") for r in rows[:40]]), 3)
        assert sorted(map(tuple, got.collect())) == brute(rows, rows[:40], 3)
