"""Rows of arrays through the frame operators: nulls, ties, repeated keys and empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from lamina.operators import frames as fr

FLAT, NONE, HOLE = [1.0] * 16, None, [1.0] * 15 + [None]


def rows(spark, *arrays):
    return spark.createDataFrame([(k, a) for k, a in enumerate(arrays)], "k int, a array<double>")


def test_nulls_and_empty(spark):
    df = rows(spark, FLAT, NONE, HOLE, [1.0] * 15 + [math.nan])
    for out in (fr.gradients(df, ["k"], "a", (4, 4)), fr.large_regions(df, ["k"], "a", (4, 4), 2), fr.embeddings(df, ["k"], "a", (4, 4), 4), fr.high_frequencies(df, ["k"], "a", (4, 4))):
        name = out.columns[-1]
        assert {r.k: r[name] is None for r in out.collect()} in ({0: False, 1: True, 2: True, 3: True}, {0: True, 1: True, 2: True, 3: True})
        assert out.limit(0).count() == 0
    assert fr.corner_marks(df, ["k"], "a", (4, 4), 0.5, 1, (1, 4), (1, 4)).select("k").distinct().collect()[0].k == 0
    assert fr.separated_peaks(df.where("k > 9"), ["k"], "a", 2, 3.0, 16.0).count() == 0


def test_ties_take_the_first(spark):
    df = rows(spark, FLAT).withColumn("b", F.col("a"))
    assert fr.separated_peaks(df, ["k"], "a", 2, 8.0, 16.0).first().places == [0, 8]
    o = fr.orientations(rows(spark, [float(i % 4 == 0) for i in range(16)]).withColumn("b", F.col("a")), ["k"], "a", "b", (4, 4)).first()
    assert (o.turns, o.mirror) == (0, False) and o.score == pytest.approx(1.0)
    assert fr.ring_tracks(rows(spark, [1.0, -1.0, 5.0, 6.0]), ["k"], "a", 2, 0, 0.0, 2.0).first().radii == [1.0, None]


def test_repeated_keys_and_more_keys(spark):
    df = spark.createDataFrame([("x", 1, FLAT)] * 3 + [("y", 1, [0.0] * 16)], "s string, k int, a array<double>")
    got = fr.resized_masks(df, ["s", "k"], "a", (4, 4)).collect()
    assert sorted((r.s, sum(r.grown), sum(r.shrunk)) for r in got) == [("x", 16, 16)] * 3 + [("y", 0, 0)]


def test_split_runs(spark):
    runs = spark.createDataFrame([(1, 0.0, 9.0, 3.0), (2, 0.0, 4.4, 3.0), (3, 0.0, 6.0, None), (4, 5.0, 5.0, 3.0), (5, 0.0, 7.5, 3.0)], "k int, lo double, hi double, m double")
    got = {}
    for r in fr.split_runs(runs, "lo", "hi", F.col("m")).orderBy("k", "part").collect():
        got.setdefault(r.k, []).append((r.lo, r.hi))
    # 7.5 / 3 is halfway: to even
    assert got == {1: [(0.0, 3.0), (3.0, 6.0), (6.0, 9.0)], 2: [(0.0, 4.4)], 3: [(0.0, 6.0)], 4: [(5.0, 5.0)], 5: [(0.0, 3.75), (3.75, 7.5)]}


def test_unreachable_pixels(spark):
    wall = [1.0, 0.0, 1.0] * 3
    df = spark.createDataFrame([(1, wall, [0.0, 0.0])], "k int, a array<double>, s array<double>")
    d = fr.distances_inside(df, ["k"], "a", "s", (3, 3)).first().distances
    assert d == [0.0, None, None, 1.0, None, None, 2.0, None, None]
