"""Edge cases by hand: empty tables, single rows, nulls, ties, the seam of a circle."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import geometry
from lamina.functions import semantics as sem
from lamina.operators import aggregates as agg
from lamina.operators import composites, interp, kernel_ops, matching, ordered
from lamina.plans import spiral


def frame(spark, rows, schema="k int, i int, v double"):
    return spark.createDataFrame(rows, schema)


def out(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_semantics(spark):
    f = frame(spark, [(0, 0, 2.5), (0, 1, float("nan")), (0, 2, None)])
    r = f.orderBy("i").select(sem.rint(F.col("v")).alias("r"), sem.number(F.col("v")).alias("n"), sem.wrap_angle(F.lit(math.pi)).alias("w"), sem.first_argmax(F.array(F.lit(1), F.lit(3), F.lit(3))).alias("m"), sem.ratio(F.lit(1), F.lit(0)).alias("z")).collect()
    assert r[0].r == 2 and r[1].n is None and r[2].n is None and r[0].w == pytest.approx(-math.pi) and r[0].m == 1 and r[0].z is None


def test_runs(spark):
    on = [0, 1, 1, 0, 1, 0, 1, 1, 1]
    f = frame(spark, [(0, i, float(v)) for i, v in enumerate(on)] + [(1, 0, 0.0)])
    assert out(ordered.runs(f, ["k"], "i", F.col("v") > 0)) == [(0, 0, 1, 2, 2), (0, 1, 4, 4, 1), (0, 2, 6, 8, 3)]
    assert out(ordered.runs(f, ["k"], "i", F.col("v") > 0, 1)) == [(0, 0, 1, 2, 2), (0, 1, 6, 8, 3)]
    wrapped = frame(spark, [(0, i, float(v)) for i, v in enumerate([1, 0, 0, 1])] + [(1, i, 1.0) for i in range(4)])
    assert out(ordered.circular_runs(wrapped, ["k"], "i", F.col("v") > 0, 4)) == [(0, 0, 3, 4, 2), (1, 0, 0, 3, 4)]
    assert out(ordered.runs(frame(spark, []), ["k"], "i", F.col("v") > 0)) == []


def test_infill_and_healing(spark):
    f = frame(spark, [(0, 0, 0.0), (0, 1, 10.0), (0, 2, 20.0), (0, 3, 40.0), (1, 0, 5.0)])
    assert out(ordered.infill_spacing(f.select("k", "v"), ["k"], "v")) == [(0, 0.0, False), (0, 10.0, False), (0, 20.0, False), (0, 30.0, True), (0, 40.0, False), (1, 5.0, False)]
    void = frame(spark, [(0, 0, x) for x in (0.0, 10.0, 20.0, 120.0, 130.0)])
    assert len(out(ordered.infill_spacing_local(void.select("k", "v"), ["k"], "v"))) == 5
    y = [float(i) for i in range(12)]
    y[5] = 99.0
    h = ordered.heal_outliers(frame(spark, [(0, i, v) for i, v in enumerate(y)]), ["k"], "i", "v", 3).orderBy("i").collect()
    assert [r.outlier for r in h] == [i == 5 for i in range(12)] and h[5].healed == pytest.approx(5)
    filled = ordered.fill_between(frame(spark, [(0, 0, None), (0, 1, 1.0), (0, 2, None), (0, 3, 3.0), (0, 4, None)]), ["k"], "i", F.col("v"), "f")
    assert [r.f for r in filled.orderBy("i").collect()] == [1, 1, 2, 3, 3]


def test_order_and_partitions_do_not_matter(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(i), float(rng.normal())) for k in range(3) for i in range(40)]
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    for op in (lambda f: ordered.leave_one_out(f, ["k"], "i", "v"), lambda f: ordered.arc_length(f, ["k"], "i", "i", "v"), lambda f: ordered.unslip(f, ["k"], "i", "v", 0.7)):
        a, b = (out(op(frame(spark, r).repartition(n))) for r, n in ((rows, 1), (shuffled, 7)))
        assert [[round(x, 9) if isinstance(x, float) else x for x in r] for r in a] == [[round(x, 9) if isinstance(x, float) else x for x in r] for r in b]


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([(0, 1.0), (0, 5.0), (0, 9.0), (1, 1.0)], "k int, t double")
    right = spark.createDataFrame([(0, 1.0, "a"), (0, 4.0, "b"), (0, 6.0, "c")], "k int, t double, x string")
    assert out(matching.asof(left, right, ["k"], "t", ["x"]))[:3] == [(0, 1.0, "a", 1.0), (0, 5.0, "b", 4.0), (0, 9.0, "c", 6.0)]
    assert out(matching.asof(left, right, ["k"], "t", ["x"], forward=True))[2] == (0, 9.0, None, None)
    assert [r[2] for r in out(matching.nearest(left, right, ["k"], "t", ["x"]))] == ["a", "b", "c", None]
    assert [r[2] for r in out(matching.nearest(left, right, ["k"], "t", ["x"], 0.5))] == ["a", None, None, None]


def test_interpolation(spark):
    knots = spark.createDataFrame([(0, 0.0, 0.0), (0, 10.0, 5.0)], "k int, t double, v double")
    q = spark.createDataFrame([(0, -1.0), (0, 5.0), (0, 12.0)], "k int, t double")
    assert [r[2] for r in out(interp.interpolate(q, knots, ["k"], "t", "v"))] == [0, 2.5, 5]
    assert [r[2] for r in out(interp.interpolate(q, knots, ["k"], "t", "v", "null"))] == [None, 2.5, None]
    circle = spark.createDataFrame([(0, 0.5, 1.0), (0, 3.5, 3.0)], "k int, t double, v double")
    assert out(interp.circular_interpolate(spark.createDataFrame([(0, 0.0)], "k int, t double"), circle, ["k"], "t", "v", 4.0))[0][2] == pytest.approx(2.0)
    img = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 3.0)], "row int, col int, v double")
    p = spark.createDataFrame([(0.5, 0.5), (5.0, 5.0)], "x double, y double")
    assert [r[2] for r in out(interp.bilinear(p, img, [], "x", "y", "v"))] == [1.5, 0.0]


def test_scores(spark):
    f = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 0), ("b", 0, 0)], "c string, p int, t int")
    s = {(r.c, r.cls): r for r in agg.scores(agg.confusion(f, ["c"], "p", "t", [0, 1])).collect()}
    assert s["a", 1].dice == pytest.approx(2 / 3) and s["b", 1].dice is None and s["b", 0].iou == 1
    assert agg.macro(agg.scores(agg.confusion(f, ["c"], "p", "t", [0, 1])), []).first().dice == pytest.approx(((2 / 3 + 1) / 2 + 2 / 3) / 2)
    assert agg.psnr_of(F.lit(0.0)) is not None
    line = [(0, i, 2.0 * i + 1) for i in range(20)]
    line[7] = (0, 7, 90.0)
    c = agg.clipped_line(frame(spark, line), ["k"], "i", "v", 3, floor=0.1).orderBy("i").collect()
    assert [r.used for r in c] == [i != 7 for i in range(20)] and c[7].fit == pytest.approx(15)


def test_spiral_end_to_end(spark):
    """The winding count is the truth and the strip correlates with it at 0.98 at least."""
    got = spiral.unroll(spark, spiral.Spiral(noise=0.05)).toPandas()
    assert sorted(got["winding"].unique()) == [0, 1, 2, 3] and sorted(got["z"].unique()) == [0, 1, 2]
    assert got[["v", "truth"]].corr().iloc[0, 1] > 0.98


def test_heal_over_z(spark):
    rows = [(0, 3, z, 20.0 + 0.01 * z if z != 17 else 29.0) for z in range(40)]
    h = {r.z: r for r in spiral.heal_over_z(spark.createDataFrame(rows, "winding int, bin int, z int, r double")).collect()}
    assert h[17].origin == "healed" and h[17].r == pytest.approx(20.17) and h[16].origin == "walked"


def test_greedy(spark):
    p = spark.createDataFrame([(0, 1, 1, 0.1), (0, 1, 2, 0.2), (0, 2, 1, 0.15), (0, 2, 2, 0.9)], "k int, a int, b int, c double")
    assert out(kernel_ops.greedy_pairs(p, ["k"], "a", "b", "c")) == [(0, 1, 1, 0.1), (0, 2, 2, 0.9)]


def test_resample_index_without_joins(spark):
    rows = [(0, 0, 0.0), (0, 1, 1.0), (0, 3, 9.0), (0, 4, None), (1, 0, 7.0), (2, 0, 1.0), (2, 1, 3.0), (2, 1, 5.0), (3, None, 1.0), (None, 0, 2.0), (None, 1, 2.0)]
    for n_out in (1, 2, 4, 7, 100):
        r = interp.resample_index(frame(spark, rows), ["k"], "i", "v", n_out)
        want = []
        for k in (0, 1, 2, 3):
            own = [(i, v) for q, i, v in rows if q == k and i is not None]
            n = max((i for i, _ in own), default=-1) + 1
            for c in range(n_out) if n else ():
                at = c * (n - 1) / (n_out - 1) if n_out > 1 else 0.0
                lo = min(int(at), max(n - 2, 0))
                for a in (v for i, v in own if i == lo):
                    for b in [v for i, v in own if i == lo + 1] or [None]:
                        want.append((k, c, None if a is None else a + ((a if b is None else b) - a) * (at - lo)))
        assert out(r) == sorted(want, key=lambda x: tuple((y is None, y) for y in x))
        assert "Join" not in r._jdf.queryExecution().executedPlan().toString()  # one that is broadcast filled the driver


def test_winding_on_ties(spark):
    """Radii halfway between two windings, where the last bit of the azimuth must not decide."""
    rows = [(k, u, round(40.0 + 40.0 * k + 0.4 * u, 2)) for k in range(11) for u in range(100)]
    f = frame(spark, [*rows, (0, 0, None)])
    phi = F.col("i") / 100.0 * (2 * math.pi)
    assert f.where(geometry.winding_of(F.col("v"), phi, 20.0, 40.0, 12) != F.col("k")).count() == 0


def test_cut_cells_repeats_no_row(spark):
    """Cells that span very many buckets, equal bounds, columns on bounds and outside, nulls."""
    bounds = spark.createDataFrame([(0, 10.0), (0, 20.0), (0, 20.0), (0, 1e12), (1, 5.0), (2, None), (2, 0.0), (2, 4.0), (None, 0.0), (None, 9.0)], "k int, at double")
    points = frame(spark, [(0, i, 0.0) for i in (9, 10, 19, 20, 21, 2000000000)] + [(1, 5, 0.0), (2, 0, 1.0), (2, 4, 1.0), (2, None, 1.0), (0, 10, 2.0), (None, 1, 0.0), (3, 1, 0.0)])
    r = composites.cut_cells(points, bounds, ["k"], "i", 1.0)
    wide = (20.0, 2, 1e12)
    assert r.columns == ["k", "i", "v", "c_lo", "cell", "c_hi"] and dict(r.dtypes)["i"] == "int"
    assert out(r) == [(0, 10, 0.0, 10.0, 0, 20.0), (0, 10, 2.0, 10.0, 0, 20.0), (0, 19, 0.0, 10.0, 0, 20.0), *[(0, i, 0.0, *wide) for i in (20, 21, 2000000000)], (2, 0, 1.0, 0.0, 1, 4.0)]


def test_series_places_of_streams(spark):
    """Series longer and shorter than a batch, a null key, null samples; places in more than one batch."""
    rows = [(k, i, None if i == 7 else float(i + 100 * (k or 0))) for k in (0, 1, 2, None) for i in range(25 * ((k or 0) + 1))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        f = frame(spark, rows[::-1], "g int, i int, v double").repartition(3)
        got = out(kernel_ops.series_places(f, ["g"], "i", "v", lambda a: np.repeat(a, 1000)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(k, 1000 * i + j, math.nan if v is None else v) for k, i, v in rows for j in range(1000)]
    same = lambda rs: sorted(str(tuple(r)) for r in rs)
    assert same(got) == same(want)
    assert out(kernel_ops.series_places(f.where("false"), ["g"], "i", "v", lambda a: a)) == []


def test_interval_drops_points_outside_first(spark):
    spans = spark.createDataFrame([(1, 0.0, 3.0), (2, 2.0, 8.0), (3, 5.0, 5.0), (4, None, 9.0)], "s int, lo double, hi double")
    points = spark.createDataFrame([(i, x) for i, x in enumerate((-1.0, 0.0, 2.0, 3.0, 7.9, 8.0, 100.0, None))], "p int, x double")
    r = matching.interval(points, spans, [], "x", "lo", "hi", 3.0).select("p", "s")
    assert out(r) == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 2)]
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert out(matching.interval(points, spans.where("false"), [], "x", "lo", "hi", 3.0)) == []


def test_interval_pairs_come_in_packs(spark, tmp_path):
    """Pairs of 60 points and 30,000 spans took four bytes each in files, in the order of single points."""
    spans = spark.range(30000).select("id", (F.col("id") % 2 * 0.1).alias("lo"), (F.col("id") % 2 + 2.0).alias("hi"))
    points = spark.range(60).select(F.col("id").alias("p"), (F.col("id") % 4 * 0.1 + 1.0).alias("x"))
    matching.interval(points, spans, [], "x", "lo", "hi", 3.0).select("p", "id").write.parquet(f"{tmp_path}/pairs")
    r = spark.read.parquet(f"{tmp_path}/pairs")
    assert r.count() == r.distinct().count() == 1800000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 1800000


def test_interval_of_many_packs_is_a_plain_join(spark):
    u = lambda seed: F.rand(seed) * 20 - 10
    points = spark.range(3000).select("id", (F.col("id") % 3).alias("k"), F.round(u(1), 1).alias("x")).union(spark.createDataFrame([(3000, 0, -0.0), (3001, 1, float("nan")), (3002, 2, None), (3003, None, 1.0)], "id long, k long, x double"))
    spans = spark.range(1500).select(F.col("id").alias("s"), (F.col("id") % 4).alias("k"), F.round(u(2), 1).alias("lo"), F.rand(3).alias("w"))
    spans = spans.select("s", "k", "lo", (F.col("lo") + F.when(F.col("s") % 7 == 0, 9.0).otherwise(F.round("w", 1) - 0.1)).alias("hi"))
    inside = (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))
    for keys, s in (([], spans.drop("k")), (["k"], spans)):
        got = matching.interval(points, s, keys, "x", "lo", "hi", 2.0)
        want = points.join(s, keys).where(inside) if keys else points.crossJoin(s).where(inside)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert out(got) == out(want) and got.count() > 50000
