"""Operators on blocks, in the plane, on regions and in rounds against slow references."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import blocks, matching, regions, rounds


def strip_frame(spark, images, width):
    rows = [(k, y, [None if v != v else float(v) for v in line]) for k, a in images.items() for y, line in enumerate(a)]
    return blocks.to_blocks(spark.createDataFrame(rows, "k int, row long, v array<double>"), ["k"], "row", "v", width)


def to_images(df, values="values"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["k"], r["row"], r["block"])):
        out.setdefault(r["k"], {}).setdefault(r["row"], []).extend(math.nan if x is None else x for x in r[values])
    return {k: np.array([v[y] for y in sorted(v)], float) for k, v in out.items()}


@pytest.mark.parametrize(("height", "width", "margin"), [(4, 5, 3), (100, 64, 3), (1, 3, 3)])
def test_map_blocks_equals_the_whole(spark, height, width, margin):
    rng = np.random.default_rng(1)
    images = {1: rng.normal(size=(11, 23)), 2: rng.normal(size=(1, 2)), 3: rng.normal(size=(9, 15))}
    images[3][2, 7] = np.nan

    def f(a):
        w = np.lib.stride_tricks.sliding_window_view(np.pad(a, 3, mode="edge"), (7, 7))
        return np.median(w, axis=(2, 3)) + w[..., 0, 6]

    got = to_images(blocks.map_blocks(strip_frame(spark, images, width), ["k"], "row", height, width, margin, f))
    assert got.keys() == images.keys()
    for k, a in images.items():
        assert np.array_equal(got[k], f(a), equal_nan=True)


def test_blocks_edges(spark):
    a = strip_frame(spark, {1: np.arange(12.0).reshape(2, 6)}, 4)
    assert sorted((r.row, r["values"]) for r in blocks.whole_rows(a, ["k"], "row").collect()) == [(0, [0.0, 1, 2, 3, 4, 5]), (1, [6.0, 7, 8, 9, 10, 11])]
    assert blocks.map_blocks(a.limit(0), ["k"], "row", 2, 4, 1, lambda x: x).count() == 0
    with pytest.raises(ValueError):
        blocks.map_blocks(a, ["k"], "row", 2, 4, 5, lambda x: x)
    none = spark.createDataFrame([(1, 0, None), (1, 1, [])], "k int, row long, v array<double>")
    assert blocks.to_blocks(none, ["k"], "row", "v", 4).count() == 0


@pytest.mark.parametrize(("height", "width"), [(2, 3), (50, 50)])
def test_samples(spark, height, width):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(7, 10))
    a[3, 4] = np.nan
    pts = [(i, *p) for i, p in enumerate([(0.0, 0.0), (6.0, 9.0), (6.0, 9.1), (2.5, 3.5), (2.0, 3.5), (3.0, 3.0), (1.999, 2.999), (-0.1, 1.0), (1.0, -0.5), (4.0, 4.0), (6.5, 1.0), (None, 1.0), (2.0, 5.999)])]
    got = {r.i: r.v for r in blocks.sample(spark.createDataFrame([(1, *p) for p in pts], "k int, i int, y double, x double"), strip_frame(spark, {1: a}, width), ["k"], "row", height, width, F.col("y"), F.col("x")).collect()}
    for i, y, x in pts:
        want = 0.0 if y is not None and y >= 0 and x >= 0 else None
        if want is not None:
            y0, x0 = int(y), int(x)
            for yy, wy in ((y0, 1 - (y - y0)), (y0 + 1, y - y0)):
                for xx, wx in ((x0, 1 - (x - x0)), (x0 + 1, x - x0)):
                    if wy and wx and want is not None:
                        ok = yy < 7 and xx < 10 and a[yy, xx] == a[yy, xx]
                        want = want + wy * wx * a[yy, xx] if ok else None
        assert got[i] is None if want is None else got[i] == pytest.approx(want), (i, y, x)


def test_rectify_reads_between_leaning_rails(spark):
    """A strip whose values are its places, so each sample says where it was read."""
    y, x = np.mgrid[:60, :400]
    strip = strip_frame(spark, {1: 1000.0 * y + x, 2: 1000.0 * y + x}, 64)
    rails = [(1, s, float(u), 10.0 + 42 * s, u + 3.0 + 2 * s) for s in (0, 1) for u in range(0, 401, 50)] + [(2, 0, 0.0, 1.0, 1.0)]
    out = blocks.rectify(strip, spark.createDataFrame(rails, "k int, side int, u double, y double, x double"), ["k"], "row", 16, 64, (10.0, 50.0), 50.0, rows=(20.0, 5)).collect()
    assert {r.k for r in out} == {1} and {r.cell for r in out} == set(range(8)) and len(out) == 40
    for r in out:
        t = (20.0 + r.row - 10) / 40
        for j, v in enumerate(r["values"]):
            at = r.cell * 50 + j + 3 + 2 * t
            assert v is None if at > 399 else v == pytest.approx(1000 * (10 + 42 * t) + at)


def test_nearest_in_plane(spark):
    rng = random.Random(3)
    right = [(k, rng.choice([rng.uniform(0, 1), rng.uniform(90, 100), float(rng.randrange(5))]), rng.uniform(0, 10), i) for k in (1, 2) for i in range(150)]
    right += [(1, 50.0, 50.0, 900), (1, 50.0, 50.0, 800), (1, 54.0, 50.0, 700), (1, None, 0.0, 1), (1, math.nan, 0.0, 2), (3, 1e6, 1e6, 5)]
    left = [(k, rng.uniform(-50, 150), rng.uniform(-20, 30), i) for k in (1, 2) for i in range(120)]
    left += [(1, 52.0, 50.0, 500), (1, 52.0, 50.0, 500), (1, 50.0, 50.0, 501), (1, None, 1.0, 502), (4, 0.0, 0.0, 503), (3, 0.0, 0.0, 504)]
    frames = spark.createDataFrame(left, "k int, x double, y double, i int"), spark.createDataFrame(right, "k int, x double, y double, j int")
    for cell in (None, 0.7, 500.0):
        got = matching.nearest_in_plane(*frames, ["k"], "x", "y", ["j"], cell).collect()
        assert len(got) == len(left)
        for r in got:
            options = [((a - r.x) ** 2 + (b - r.y) ** 2, j) for k, a, b, j in right if k == r.k and r.x is not None and a is not None and a == a]
            assert (r.j, r.distance) == (None, None) if not options else (r.j == min(options)[1] and r.distance == pytest.approx(math.sqrt(min(options)[0])))
    e = frames[1].limit(0)
    assert {r.j for r in matching.nearest_in_plane(frames[0].drop("k"), e.drop("k"), [], "x", "y", ["j"]).collect()} == {None}
    with pytest.raises(ValueError):
        matching.nearest_in_plane(frames[0], frames[0], ["k"], "x", "y", ["i"])


def flood(on):
    """Each voxel's region by a walk: its least voxel number."""
    out = np.full(on.shape, -1, np.int64)
    number = lambda p: (p[0] << 42) + (p[1] << 21) + p[2]
    for p in zip(*np.nonzero(on), strict=True):
        if out[p] < 0:
            todo, seen = [tuple(map(int, p))], {tuple(map(int, p))}
            while todo:
                q = todo.pop()
                for axis in range(3):
                    for step in (-1, 1):
                        n = tuple(q[i] + step * (i == axis) for i in range(3))
                        if all(0 <= n[i] < on.shape[i] for i in range(3)) and on[n] and n not in seen:
                            seen.add(n)
                            todo.append(n)
            for q in seen:
                out[q] = number(min(seen))
    return out


@pytest.mark.parametrize(("depth", "height", "width"), [(1, 1, 2), (2, 3, 4), (9, 99, 99)])
def test_regions(spark, depth, height, width):
    rng = np.random.default_rng(4)
    on = rng.random((4, 7, 9)) < 0.45
    snake = np.zeros((3, 7, 9), bool)
    snake[0, ::2], snake[0, 1::4, -1], snake[0, 3::4, 0], snake[2, 6, 8], snake[1, 6, 8] = True, True, True, True, True
    for stack in (on, snake, np.zeros((2, 2, 2), bool), np.ones((3, 4, 5), bool)):
        rows = [(7, z, y, [float(v) for v in line]) for z, a in enumerate(stack) for y, line in enumerate(a)]
        b = blocks.to_blocks(spark.createDataFrame(rows, "k int, z int, row int, v array<double>"), ["k", "z"], "row", "v", width)
        got = np.full(stack.shape, -1, np.int64)
        for r in regions.label_regions(b, ["k"], "z", "row", depth, height, width).collect():
            got[r.z, r.row, r.block * width : r.block * width + len(r.labels)] = [-1 if v is None else v for v in r.labels]
        assert (got == flood(stack)).all()


def test_connected(spark):
    edges = [(1, i, i + 1) for i in range(60)] + [(2, 5, 5), (2, 9, 3), (2, 3, None), (2, 9, 3), (1, 100, 101)]
    got = {(r.k, r.node): r.root for r in regions.connected(spark.createDataFrame(edges, "k int, a long, b long"), ["k"]).collect()}
    assert got == {**{(1, i): 0 for i in range(61)}, (2, 5): 5, (2, 9): 3, (2, 3): 3, (1, 100): 100, (1, 101): 100}


@pytest.mark.parametrize("width", [3, 50])
def test_squared_distances(spark, width):
    rng = np.random.default_rng(5)
    images = {1: (rng.random((9, 13)) < 0.05) * 1.0, 2: np.zeros((3, 4)), 3: np.zeros((8, 20)), 4: np.ones((2, 2))}
    images[3][7, 19] = 1
    images[1][0, 0] = np.nan
    got = to_images(regions.squared_distances(strip_frame(spark, images, width), ["k"], "row", width))
    for k, a in images.items():
        own = [(y, x) for y, x in zip(*np.nonzero(np.nan_to_num(a) > 0), strict=True)]
        want = np.array([[min(((y - p) ** 2 + (x - q) ** 2 for p, q in own), default=np.nan) for x in range(a.shape[1])] for y in range(a.shape[0])], float)
        assert np.array_equal(got[k], want, equal_nan=True)


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_exact_quantiles(spark, bins):
    rng = random.Random(6)
    for values in ([5.0], [1.0, 2.0], [3.0] * 40, [rng.lognormvariate(0, 9) for _ in range(300)], [rng.choice([0.0, 1e-300, -1e300, 2.5]) for _ in range(50)], [float(rng.randrange(6)) for _ in range(99)]):
        df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double")
        shares = [0.0, 0.05, 0.5, 0.937, 1.0]
        assert rounds.exact_quantiles(df, "v", shares, bins) == pytest.approx([float(np.percentile(values, 100 * s)) for s in shares], rel=1e-12)
    assert rounds.exact_quantiles(df.limit(0), "v", [0.5]) == [None]


def test_fit_spirals(spark):
    rng = random.Random(7)
    rows = []
    for key, (a, b, wave) in {1: (12.0, 7.0, 0.6), 2: (13.0, 7.4, 0.0)}.items():
        for _ in range(600):
            phi, k = rng.uniform(0, 2 * math.pi), rng.randrange(6)
            rows.append((key, phi, a + b * (k + phi / (2 * math.pi)) + wave * math.cos(phi)))
    rows += [(1, 1.0, 500.0), (1, None, 3.0), (2, 1.0, math.nan), (3, 1.0, 20.0)]
    df = spark.createDataFrame(rows, "k int, phi double, r double")
    got = {r.k: r for r in rounds.fit_spirals(df, ["k"], "phi", "r", 6, (12.5, 7.2), harmonics=1, gate=6.0, rounds=12).collect()}
    assert got[1].coefficients == pytest.approx([12, 7, 0.6, 0], abs=1e-6) and got[1].n == 600
    assert got[2].n == 600 and got[3].coefficients == [12.5, 7.2, 0.0, 0.0]
    assert got[1].rounds < 12
    assert rounds.fit_spirals(df.limit(0), ["k"], "phi", "r", 6, (20.0, 8.0)).count() == 0


def test_lock_profiles(spark):
    rng = np.random.default_rng(8)
    base = np.cumsum(rng.normal(size=60))
    true = [int(s) for s in rng.integers(-3, 4, 15)]
    true = [s - int(np.median(true)) for s in true]
    rows = [(1, i, at, float(np.interp(at - s, np.arange(60), base))) for i, s in enumerate(true) for at in range(10, 50)]
    rows += [(1, 90, 3, None), (2, 1, 0, 1.0)]
    got = {(r.k, r.i): r["shift"] for r in rounds.lock_profiles(spark.createDataFrame(rows, "k int, i int, at int, v double"), ["k"], "i", "at", "v", 6).collect()}
    assert len(got) == 17 and got[1, 90] == 0 and got[2, 1] == 0
    assert len({got[1, i] - s for i, s in enumerate(true)}) == 1


def test_local_lines_with_outliers(spark):
    rng = np.random.default_rng(9)
    u = np.sort(rng.uniform(0, 60, 80)).round(3)
    y = 3 + 0.5 * u + rng.normal(size=80) * 0.1
    y[[10, 40]] += 50
    rows = [(1, float(a), float(b)) for a, b in zip(u, y, strict=True)] + [(1, 61.0, None), (2, 5.0, 7.0), (3, 1.0, None)]
    got = {(r.k, r.u): r.smooth for r in rounds.local_lines(spark.createDataFrame(rows, "k int, u double, y double"), ["k"], "u", "y", 2.0, rounds=3).collect()}
    weight, at = np.ones(80, bool), np.append(u, 61.0)
    for k in range(3):
        smooth = []
        for p in at:
            near = weight & (np.abs(u - p) <= 8)
            g, d = np.exp(-0.5 * ((u[near] - p) / 2) ** 2), u[near] - p
            c = np.linalg.lstsq(np.sqrt(g)[:, None] * np.stack([np.ones_like(d), d], 1), np.sqrt(g) * y[near], rcond=None)[0]
            smooth.append(c[0])
        off = np.abs(y - smooth[:80])
        weight = off <= 4 * 1.4826 * np.median(off) + 1e-12 if k < 2 else weight
    assert [got[1, float(p)] for p in at] == pytest.approx(smooth, abs=1e-6)
    assert got[2, 5.0] == 7.0 and got[3, 1.0] is None and abs(got[1, float(u[10])] - 3 - 0.5 * u[10]) < 0.3


def test_held_places(spark):
    measures = [(1, i, 100.0 * i, 2.0, 1.0, 0.9 if i in (2, 6) else 0.1) for i in range(9)] + [(2, i, 10.0 * i, 1.0, 1.0, None) for i in range(3)]
    measures[6] = (1, 6, 600.0, 10.0, 5.0, 0.9)
    steps = [(1, i, 3.0, 0.5) for i in range(9)]
    m = spark.createDataFrame(measures, "k int, i int, x0 double, along double, across double, score double")
    got = {(r.k, r.i): (r.x, r.z, r.locked) for r in rounds.held_places(m, spark.createDataFrame(steps, "k int, i int, along double, across double"), ["k"], "i", 0.5, 50.0).collect()}
    assert got[1, 2] == (202.0, 1.0, True) and got[1, 6] == (610.0, 5.0, True)
    # steps of 103 each miss the anchor by 4 less: a quarter of that for each frame of the gap
    assert [got[1, i][0] for i in (3, 4, 5)] == pytest.approx([304.0, 406.0, 508.0])
    assert [got[1, i][1] for i in (3, 4, 5)] == pytest.approx([2.0, 3.0, 4.0])
    assert got[1, 8][0] == pytest.approx(816.0) and got[1, 0][0] == pytest.approx(-4.0) and got[2, 1] == (10.0, 0.0, False)
