"""Kernels on inputs made so that the result is known in closed form, which SQL states: rings, exact waves,
reels that jump by a known step. They test kernels; the library's queries read the tables."""

from __future__ import annotations

import sys

import duckdb
import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lamina.kernels import frames, image, signal, steady, walk
from lamina.kernels.image import gaussian, gradient_correlation, sobel
from lamina.operators import kernel_ops as k
from lamina.operators import steady as op
from lamina.plans import spiral

#: Workers can't import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
FORMS: dict = {}


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def query(name, sql=None):
    def add(f):
        FORMS[name] = (f, sql)
        return f

    return add


def _numbered(spark, n, f, names):
    """``f`` of each number from 0 to n - 1."""
    rows = spark.range(n).select(F.col("id").alias("k"), F.array(F.col("id").cast("double")).alias("a"), F.array(F.col("id").cast("double")).alias("b"))
    return r6(k.pair_numbers(rows, ["k"], "a", "b", None, lambda a, _: f(int(a[0])), names), *names)


def _ring(r: float, c: float, n: int = 400) -> np.ndarray:
    t = 0.3 + np.arange(n) * (walk.TWO_PI - 0.05) / n
    return np.stack([c + r * np.cos(t), c + r * np.sin(t)], 1)


def _texture(h: int, w: int, seed: int, sigma: float = 1.5) -> np.ndarray:
    return gaussian(np.random.default_rng(seed).normal(size=(h, w)), sigma) * 4


@query("round_a_ring", """
SELECT k, 12.0 + k AS radius, 1.0 AS turns, 12.0 + k AS recentred, 2.0 AS offset_, 12.0 + k AS profile, 2.0 AS kept, 1.0 AS smoothed FROM (SELECT unnest(range(12)) AS k)""")  # fmt: skip
def round_a_ring(spark, d):
    """A band of known radius: followed, recentred on, measured against, profiled, smoothed."""
    names = ["radius", "turns", "recentred", "offset_", "profile", "kept", "smoothed"]

    def f(i):
        r = 12.0 + i
        c = r + 8.0
        y, x = np.mgrid[: int(2 * c) + 1, : int(2 * c) + 1]
        band = np.abs(np.hypot(x - c, y - c) - r) <= 1.3
        path = walk.follow(band, (c + r, c), 1, c, c, -0.02)
        kept = walk.dedup_by_profile([_ring(r, c), _ring(r + 0.3, c, 450), _ring(r - 6, c)], c, c, 0.3, 1.5)
        smooth = walk.smooth_path(_ring(r, c), 0.4)
        return {
            "radius": np.rint(walk.median_radius(path, c, c)),
            "turns": np.rint((len(path) - 1) * 2 / (walk.TWO_PI * r)),
            "recentred": np.rint(walk.median_radius(walk.recentre(_ring(r + 0.8, c), band), c, c)),
            "offset_": np.rint(np.nanmedian(np.abs(walk.offsets_to_band(_ring(r - 2, c), band)))),
            "profile": np.nanmedian(walk.profile(_ring(r, c), c, c, 0.3)),
            "kept": len(kept),
            "smoothed": float(np.sqrt(((smooth - _ring(r, c)) ** 2).mean(axis=0)).max() <= 0.4),
        }

    return _numbered(spark, 12, f, names)


@query("traced_rings", "SELECT k, 2.0 AS windings, 14.0 + k AS \"inner\", 22.0 + k AS \"outer\", 1.0 AS bare FROM (SELECT unnest(range(6)) AS k)")
def traced_rings(spark, d):
    """Two bands traced from scratch; the bare band among four known windings found."""

    def f(i):
        r = 14.0 + i
        c = r + 16.0
        y, x = np.mgrid[: int(2 * c) + 1, : int(2 * c) + 1]
        d_ = np.hypot(x - c, y - c)
        paths = walk.trace((np.abs(d_ - r) <= 1.3) | (np.abs(d_ - r - 8) <= 1.3), c, c, 5.0, c, 0.3)
        radii = [np.rint(walk.median_radius(p, c, c)) for p in paths]
        known = [_ring(x, c) for x in (r - 8, r - 4, r, r + 8)]
        bare = walk.bare_bands(known, np.abs(d_ - r - 4) <= 1.3, c, c, 0.3)
        return {"windings": len(paths), "inner": radii[0], "outer": radii[-1], "bare": sum(abs(m - r - 4) < 0.5 for _, m in bare)}

    return _numbered(spark, 6, f, ["windings", "inner", "outer", "bare"])


@query("matched_profiles", "SELECT k, 3.0 AS matched, 0.25 AS drift, 4.0 AS tracks FROM (SELECT unnest(range(8)) AS k)")
def matched_profiles(spark, d):
    """Walks that drift by a quarter keep their tracks; one that none is near opens another."""

    def f(i):
        tracks = [np.full(96, 10.0 + i + 4 * j) for j in range(3)]
        walks = [t + 0.25 for t in tracks[::-1]] + [np.full(96, 80.0)]
        taken, drift = walk.match_profiles(tracks, walks, 1.0)
        tracker = walk.Tracker(1.0)
        tracker.step(0, tracks)
        ids = tracker.step(1, walks)
        return {"matched": sum(taken[j] == 2 - j for j in range(3)), "drift": drift, "tracks": len(tracker.profiles) if ids == [2, 1, 0, 3] else -1}

    return _numbered(spark, 8, f, ["matched", "drift", "tracks"])


@query("known_pitch", "SELECT k, 8.0 + k AS pitch, 8.0 + k AS refined, 8.0 + k AS phase, 39.0 AS bounds FROM (SELECT unnest(range(10)) AS k)")
def known_pitch(spark, d):
    """Forty whole periods of a wave: the pitch by three ways, and the peaks between the ends."""

    def f(i):
        p = 8.0 + i
        a = np.cos(walk.TWO_PI * np.arange(int(40 * p)) / p)
        e = signal.estimate_pitch(a, 5, 30)
        return {"pitch": round(e, 1), "refined": round(signal.refine_pitch(a, e), 1), "phase": round(signal.phase_pitch(a, p), 1), "bounds": len(signal.boundaries(a, p))}

    return _numbered(spark, 10, f, ["pitch", "refined", "phase", "bounds"])


@query("straight_splines", "SELECT k, round(0.5 + 0.1 * k, 6) AS first, round(0.5 + 0.1 * k + 9.9 * (k - 3), 6) AS last FROM (SELECT unnest(range(8)) AS k)")
def straight_splines(spark, d):
    """A smoothing spline keeps a straight line."""
    x = np.arange(100) / 10

    def f(i):
        s = signal.penalised_spline(x, 0.5 + 0.1 * i + (i - 3) * x, 0.1)(x)
        return {"first": round(float(s[0]), 4), "last": round(float(s[-1]), 4)}

    return _numbered(spark, 8, f, ["first", "last"])


@query("unit_noise", "SELECT k, 0.0 AS mean, 1.0 AS deviation FROM (SELECT unnest(range(9)) AS k)")
def unit_noise(spark, d):
    def f(i):
        n = image.coarse_noise(40, 30 + i, 8, i)
        return {"mean": round(float(n.mean()), 6) + 0.0, "deviation": n.std()}

    return _numbered(spark, 9, f, ["mean", "deviation"])


@query("steadied_frames", "SELECT k, 14.0e0 AS found, 1.0e0 AS still FROM (SELECT unnest(range(3)) AS k)")
def steadied_frames(spark, d):
    """Frames that jump by a pixel are told apart and, moved, agree within the common box."""
    i = np.arange(14)
    true = np.stack([i // 2 % 2, (i + 1) // 2 % 2], axis=1)

    def f(seed):
        wide = _texture(60, 70, seed)
        reel = np.stack([wide[8 - y : 52 - y, 8 - x : 62 - x] for y, x in true])
        p, (y0, y1, x0, x1) = steady.stabilise(reel, angle=0.0)
        held = [steady.moved(a, *q)[y0:y1, x0:x1] for a, q in zip(reel, p, strict=True)]
        return {"found": (np.abs(p[:, :2] - true + true.mean(axis=0)).max(axis=1) < 0.35).sum(), "still": min(gradient_correlation(held[0], a) for a in held) > 0.9}

    return _numbered(spark, 3, f, ["found", "still"])


@query("locked_shifts", "SELECT k, 1.0e0 AS slow, 1.0e0 AS local, 0.0e0 AS across FROM (SELECT unnest(range(3)) AS k)")
def locked_shifts(spark, d):
    """A slow sway and jumps of rows, neither of which moves columns."""

    def f(seed):
        base, i = _texture(48, 48, 40 + seed), np.arange(40)
        sway, jump = np.rint(3 * np.sin(i / 6)).astype(int), (i % 7 == 3) * 2
        slow = steady.lock_slow(np.stack([np.roll(base, s, 0) for s in sway]), sigma=1.0)
        local = steady.lock_local(np.stack([sobel(base[4 - s : 44 - s]) for s in jump]))
        return {"slow": np.abs(slow[:, 0] - sway + np.median(sway)).max() < 1, "local": np.abs(local[:, 0] - jump).max() < 0.3, "across": np.rint(max(np.abs(slow[:, 1]).max(), np.abs(local[:, 1]).max()))}

    return _numbered(spark, 3, f, ["slow", "local", "across"])


@query("aperture_edges", "SELECT k, 20.5e0 + k % 5 AS \"left\", 78.5e0 + k % 7 AS \"right\" FROM (SELECT unnest(range(20)) AS k)")
def aperture_edges(spark, d):
    """Soft steps at known columns."""
    x = F.sequence(F.lit(0), F.lit(99))
    step = lambda at: lambda c: 1 / (1 + F.exp(at - c))
    lo, hi = step(F.lit(20.5) + F.col("k") % 5), step(F.lit(78.5) + F.col("k") % 7)
    reel = spark.range(20).select(F.col("id").alias("k")).withColumn("px", F.transform(x, lambda c: lo(c) - hi(c)))
    out = op.aperture_edges(reel, ["k"], "px", (1, 100), (0.2, 0.8), 0.1)
    return out.select("k", *[F.round(c, 2).alias(c) for c in ("left", "right")])


@query("aperture_boxes", "SELECT k, 12.0e0 + k AS x0, 9.0e0 + k AS y0, 188.0e0 - k AS x1, 111.0e0 - k AS y1 FROM (SELECT unnest(range(6)) AS k)")
def aperture_boxes(spark, d):
    """Dark lines inside two columns of holes and around two rows of them."""

    def f(i):
        mean = np.ones((120, 200))
        mean[:, [12 + i, 188 - i]] = 0
        mean[[9 + i, 111 - i]] = 0
        return dict(zip(("x0", "y0", "x1", "y1"), steady.aperture_box(mean, (9, 191), (10, 110)), strict=True))

    return _numbered(spark, 6, f, ["x0", "y0", "x1", "y1"])


@query("moved_borders", "SELECT k, 1.0e0 + k % 3 AS \"left\", 1.0e0 + k % 3 AS \"right\", 0.0e0 AS top, 0.0e0 AS bottom, 9.0e0 AS cuts FROM (SELECT unnest(range(6)) AS k)")
def moved_borders(spark, d):
    """One frame of nine rolled along its rows; cuts found at borders that sway along the strip."""
    x = np.arange(1000)

    def f(i):
        by, wide = 1 + i % 3, _texture(100, 100, i, 2.0)
        shifts = steady.border_shifts(np.stack([wide if j != 4 else np.roll(wide, by, 1) for j in range(9)]), 0.4, 8)[4]
        lines = 100.0 * np.arange(1, 10)
        by_cut = by * np.cos(2.0 * np.arange(9))
        strip = np.tile(sum(np.exp(-(((x - c - s) / 3.0) ** 2)) for c, s in zip(lines, by_cut, strict=True)), (5, 1))
        off = steady.register_cuts(strip, lines, 100.0, (0, 5), sigma=0.1) - lines - by_cut + np.median(by_cut)
        return {**dict(zip(("left", "right", "top", "bottom"), np.rint(shifts) + 0.0, strict=True)), "cuts": (np.abs(off) < 0.1).sum()}

    return _numbered(spark, 6, f, ["left", "right", "top", "bottom", "cuts"])


@query("template_borders", "SELECT k, 13.0e0 AS low, 13.0e0 AS high FROM (SELECT unnest(range(4)) AS k)")
def template_borders(spark, d):
    """Both borders of thirteen cells follow a drift that leaves the first search."""

    def f(seed):
        strip, drift = 0.02 * np.random.default_rng(seed).normal(size=(200, 1300)), np.arange(13)
        for j in drift:
            strip[50 + j : 150 + j, 100 * j : 100 * j + 100] += 1
        b = frames.template_borders(strip, 100.0 * np.arange(14), (56, 156), 12, reach=10)
        return {"low": (np.abs(b[:, 0] - 50 - drift) < 0.8).sum(), "high": (np.abs(b[:, 1] - 150 - drift) < 0.8).sum()}

    return _numbered(spark, 4, f, ["low", "high"])


@query("affine_aligned", "SELECT k, 1.0e0 AS aligned, 0.0e0 AS spread FROM (SELECT unnest(range(4)) AS k)")
def affine_aligned(spark, d):
    """A picture stretched, shrunk and moved agrees with the true one once aligned; pairs that all are
    stretched alike spread by nothing."""
    y, x = np.mgrid[:80, :80] - 39.5

    def f(i):
        t = _texture(80, 80, 5 + i, 2.0)
        a = steady.bilinear(t, 39.5 + 1.02 * x + 1, 39.5 + 0.99 * y - 2, outside=None)
        u, v = steady.align_affine(t, a, 4)
        return {"aligned": gradient_correlation(u[6:-6, 6:-6], v[6:-6, 6:-6]) > 0.9, "spread": round(max(steady.deform_spread(np.stack([a, a]), np.stack([t, t]))), 6)}

    return _numbered(spark, 4, f, ["aligned", "spread"])


@query("twin_tracks", "SELECT k, 4.0e0 AS windings, 1.0e0 AS twin FROM (SELECT unnest(range(5)) AS k)")
def twin_tracks(spark, d):
    """A second walk beside a winding for some slices is that winding's twin."""

    def f(i):
        base, t = [np.full(96, 20.0 + i + 8 * j) for j in range(4)], walk.Tracker(1.0)
        for z in range(6):
            t.step(z, [*base, base[2] + 2.0] if z < 3 else base)
        to = t.merged(3.0)
        return {"windings": len(t.profiles) - len(to), "twin": to == {4: 2}}

    return _numbered(spark, 5, f, ["windings", "twin"])


@query("spiral_unroll")
def spiral_unroll(spark, d):
    return spiral.unroll(spark, spiral.Spiral())


@query("spiral_geometry")
def spiral_geometry(spark, d):
    return spiral.generate(spark, spiral.Spiral(noise=0.1)).select("z", "row", F.aggregate("label", F.lit(0), lambda a, x: a + x).alias("on"), F.round(F.array_max("px"), 9).alias("top"))


@pytest.mark.parametrize("name", FORMS)
def test_form(spark, name):
    f, sql = FORMS[name]
    got = f(spark, None)
    if sql is None:
        assert got.count() > 0
        return
    want = duckdb.connect().execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted([float(v) for v in r] for r in got.select(*[f"`{c}`" for c in names]).collect())
    b = sorted([float(v) for v in r] for r in want.fetchall())
    assert a == [pytest.approx(r) for r in b]
