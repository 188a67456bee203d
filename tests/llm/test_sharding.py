import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import docs_frame

from lamina.llm import sharding
from lamina.llm.sharding import shard_documents


def smallest_capacity(sizes, shards):
    """Brute force: the least c for which a greedy fill needs at most that many shards."""
    c = max(sizes)
    while True:
        used, fill = 1, 0
        for s in sizes:
            if fill + s > c:
                used, fill = used + 1, 0
            fill += s
        if used <= shards:
            return c
        c += 1


def check(rows, got, shards):
    order = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        order.setdefault(t, 0)
        order[t] += 8 + len((t or "").encode())
    by_shard, of_text = {}, {}
    text = {i: t for i, t in rows}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r)
        of_text.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(x) == 1 for x in of_text.values())
    for r in by_shard.values():
        assert sorted(x["slot"] for x in r) == list(range(len(r)))
    assert max(sum(x["size"] for x in r) for r in by_shard.values()) == smallest_capacity(list(order.values()), shards)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.choice([0, 1, 5, 40, 300]) + str(rng.randrange(60))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "")]
    for shards in (1, 5, 24):
        check(rows, shard_documents(docs_frame(spark, rows), shards).collect(), shards)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60) | st.just(900), min_size=1, max_size=120), st.integers(1, 30), st.sampled_from([2, 5, 40, 1000]))
def test_capacity_and_cuts_from_ladders(sizes, shards, cells):
    """Ladders of any size lead to the greedy cuts of the least capacity."""
    sums, at = [], 0
    for s in sizes:
        sums.append(at := at + s)
    asked = []

    def divide(ranges, widths):
        asked.append(ranges)
        out = {}
        for r, ((a, b), w) in enumerate(zip(ranges, widths, strict=True)):
            for x in sums:
                if a < x < b:
                    out.setdefault((r, (x - a) // w), []).append(x)
        assert len(out) <= cells + 2 * len(ranges)
        return [(min(x), max(x), len(x)) for x in out.values()]

    kept, sharding.LADDER = sharding.LADDER, cells
    try:
        capacity, ends = sharding.minimax_cuts(divide, at, max(sizes), shards)
    finally:
        sharding.LADDER = kept
    assert capacity == smallest_capacity(sizes, shards)
    fill = 0
    for e in ends:
        assert e == max([x for x in sums if x <= fill + capacity], default=fill)
        fill = e
    assert fill == at and (cells < 1000 or len(asked) <= 2 + (at > 1000))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60) | st.just(900), min_size=1, max_size=120), st.integers(1, 30), st.sampled_from([2, 5, 40, 1000]))
def test_spread_cuts_from_ladders(sizes, shards, cells):
    """Spread cuts keep the least capacity, and are those of the rule on the whole list of sums."""
    sums, at = [0], 0
    for s in sizes:
        sums.append(at := at + s)

    def divide(ranges, widths):
        out = {}
        for r, ((a, b), w) in enumerate(zip(ranges, widths, strict=True)):
            for x in sums:
                if a < x < b:
                    out.setdefault((r, (x - a) // w), []).append(x)
        return [(min(x), max(x), len(x)) for x in out.values()]

    kept, sharding.LADDER = sharding.LADDER, cells
    try:
        capacity, ends = sharding.minimax_cuts(divide, at, max(sizes), shards, spread=True)
    finally:
        sharding.LADDER = kept
    assert capacity == smallest_capacity(sizes, shards) and len(ends) == shards and ends[-1] == at
    assert set(ends) <= set(sums) and max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= capacity
    rest = [at]
    for _ in range(shards - 1):
        rest.append(min(x for x in sums if x >= rest[-1] - capacity))
    start = 0
    for left, end in zip(range(shards, 1, -1), ends, strict=False):
        fit = [x for x in sums if start <= x <= start + capacity and x >= rest[left - 1]]
        even = min(start - (start - at) // left if (at - start) % left == 0 else start + (at - start) // left + 1, max(x for x in sums if x <= start + capacity))
        assert end == min(fit, key=lambda x: (abs(x - even), x))
        start = end


def test_shards_are_near_equal(spark):
    """Of many small documents every shard holds nearly its share, the last one included."""
    rng = random.Random(12)
    rows = [(i, f"{i} " + "x" * rng.randint(0, 900)) for i in range(2_000)]
    held = {}
    for r in shard_documents(docs_frame(spark, rows), 24).collect():
        held[r.shard] = held.get(r.shard, 0) + r.size
    mean = sum(held.values()) / 24
    assert len(held) == 24 and min(held.values()) > 0.97 * mean and max(held.values()) < 1.03 * mean


@pytest.mark.parametrize("cells", [7, 65_536])
def test_few_cells(spark, monkeypatch, cells):
    monkeypatch.setattr(sharding, "LADDER", cells)
    rng = random.Random(2)
    rows = [(i, "y" * rng.randint(0, 90) + str(rng.randrange(90))) for i in range(200)] + [(500, "long " * 40_000)]
    check(rows, shard_documents(docs_frame(spark, rows), 6).collect(), 6)


def test_hot_group_and_clashing_names(spark):
    rows = [(i, "same" if i % 3 else f"own {i}", 7, "s") for i in range(60)]
    got = shard_documents(docs_frame(spark, rows, ", size long, shard string"), 4).collect()
    assert set(got[0].asDict()) == {"doc_id", "size", "shard", "size_", "text_crc32", "shard_", "slot"}
    assert len({r["shard_"] for r in got if r["doc_id"] % 3}) == 1


def test_empty_and_null_ids(spark):
    assert shard_documents(docs_frame(spark, []), 3).count() == 0
    got = shard_documents(docs_frame(spark, [(None, "a"), (None, "a"), (None, None), (-(2**63), "b"), (5, "a")]), 3).collect()
    assert len(got) == 5
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append((r.slot, r.doc_id))
    order = [i for s in sorted(by) for _, i in sorted(by[s], key=lambda x: x[0])]
    assert order == [None, -(2**63), None, None, 5]


def test_equal_ids_have_their_slots_by_the_other_columns(spark):
    rows = [(1, "same", x) for x in "abcdef"]
    one, two = ({r.tag: r.slot for r in shard_documents(docs_frame(spark, x, ", tag string").repartition(n), 2).collect()} for x, n in ((rows, 1), (rows[::-1], 3)))
    assert one == two and sorted(one.values()) == list(range(6))
