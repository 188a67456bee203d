import random
import re

import numpy as np
import pytest
from llm_helpers import docs_frame

from lamina.llm import line_dedup
from lamina.llm.line_dedup import dedup_lines
from lamina.llm.perfect_hash import PerfectHash

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(SPACE))


def brute(rows, least=10):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key_of(line)) >= least:
                holders.setdefault(key_of(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [i is not None and len(holders.get(key_of(x), ())) > 1 and i != min(holders[key_of(x)]) for x in lines]
        out.append((i, "\n".join(x for x, d in zip(lines, drop, strict=True) if not d), len(lines), sum(drop)))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many shards and copies of their arrays
        for name in ("SHARD_KEYS", "COPY_PROBES"):
            monkeypatch.setattr(line_dedup, name, 5)
    rng = random.Random(3)
    pool = [f"line number {k} of the pool" for k in range(40)] + ["short", "", "  \t", "ÄÖÜ ÄÖÜ ÄÖÜ", "exactly 10", "İstanbul is a city", "a line that nearly all share"]
    rows = []
    for i in rng.sample(range(10_000), 150):
        lines = [rng.choice([x, x.upper(), f"  {x}\r", f"\x0b{x}"]) for x in rng.choices(pool, k=rng.randint(0, 9))]
        rows.append((i, "\n".join([*lines, "A LINE that nearly all share"] if i % 5 else lines)))
    rows += [(None, pool[0] + "\n" + pool[1]), (20_000, None), (20_001, ""), (20_002, "\n\n"), (rows[0][0], "A line that nearly ALL share\nanother text of the same id"), rows[3], (20_003, "one long line " * 20_000 + "\n" + pool[2]), (20_004, "same line twice in here\nsame line twice in here")]
    got = dedup_lines(docs_frame(spark, [(*r, 5) for r in rows], ", n_lines int"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_lines_", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines_, r.n_dropped) for r in got.collect()), key=str) == brute(rows)


def test_empty(spark):
    assert dedup_lines(docs_frame(spark, [])).collect() == []


def test_shards_answer_by_counts_and_refuse_other_lines():
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(-(2**63), 2**63, (2, 5000))
    first = rng.integers(0, 900, 5000)
    last = first + np.where(rng.random(5000) < 0.4, rng.integers(1, 9, 5000), 0)
    blob = line_dedup._pack(h1, h2, first, last)
    assert len(blob) < 5000 * (2 + 1 + 1) + 8 * (first < last).sum() + 500  # compact
    shard = line_dedup.Shard(blob)
    pick = rng.integers(0, 5000, 20_000)
    doc = np.where(rng.random(20_000) < 0.5, first[pick], last[pick])
    want = np.flatnonzero((first < last)[pick] & (doc != first[pick]))
    assert shard.repeats(h1[pick], h2[pick], doc).tolist() == want.tolist()
    with pytest.raises(ValueError):
        shard.repeats(h1[:50] + 1, h2[:50], doc[:50])


def test_hashes_that_mix_alike_get_another_seed():
    h1 = np.array([3, 9], np.int64)
    h2 = np.zeros(2, np.int64)
    h2[1] = (line_dedup._mixed(h1[:1], h2[:1], 0) - line_dedup._mixed(h1[1:], h2[:1], 0)).view(np.int64)[0]
    shard = line_dedup.Shard(line_dedup._pack(h1, h2, np.array([1, 2]), np.array([1, 5])))
    assert shard.seed > 0 and shard.repeats(h1, h2, np.array([1, 5])).tolist() == [1]


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 5000):
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        p = PerfectHash.from_bytes(PerfectHash(keys).to_bytes())
        assert sorted(p.index(keys).tolist()) == list(range(n)) and len(p) == n
        assert (p.index(rng.integers(0, 2**63, 50, dtype=np.uint64)) < max(n, 1)).all()
    same = np.array([7, 7, 9], np.uint64)
    assert len(PerfectHash(same)) == 3
