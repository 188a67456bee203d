import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.kernels import frames, steady, walk
from lamina.kernels.image import gaussian, gradient_correlation, sobel
from lamina.operators import steady as op


def texture(h, w, seed=0, sigma=1.5):
    return gaussian(np.random.default_rng(seed).normal(size=(h, w)), sigma) * 4


def test_stabilise():
    wide = texture(60, 70)
    i = np.arange(14)
    true = np.stack([i // 2 % 2, (i + 1) // 2 % 2], axis=1)
    reel = np.stack([wide[8 - y : 52 - y, 8 - x : 62 - x] for y, x in true])
    p, (y0, y1, x0, x1) = steady.stabilise(reel)
    assert np.abs(p[:, :2] - (true - true.mean(axis=0))).max() < 0.35 and np.abs(p[:, 2]).max() < 0.6
    held = [steady.moved(a, *q)[y0:y1, x0:x1] for a, q in zip(reel, p, strict=True)]
    assert min(gradient_correlation(held[0], a) for a in held) > 0.9
    turned = steady.moved(wide, 0, 0, 1.0)
    assert steady.register(turned, wide, angle=1.5)[2] == 1.0


def test_locks():
    base = texture(48, 48, 2)
    sway = np.rint(3 * np.sin(np.arange(40) / 6)).astype(int)
    reel = np.stack([np.roll(base, (s, -s), (0, 1)) for s in sway])
    off = steady.lock_slow(reel, sigma=1.0)
    assert np.abs(off[:, 0] - (sway - np.median(sway))).max() < 1 and np.abs(off.sum(axis=1)).max() < 0.5
    jump = (np.arange(40) % 7 == 3) * 2
    near = steady.lock_local(np.stack([sobel(base[4 - j : 44 - j]) for j in jump]))
    assert np.abs(near[:, 0] - jump).max() < 0.3 and np.abs(near[:, 1]).max() < 0.2
    v = np.zeros(20)
    v[7] = 30
    assert not steady.without_spikes(v, 7, 4).any() and steady.without_spikes(v, 7, 4, 40.0)[7] == 30


def test_apertures_and_borders():
    x = np.arange(100)
    a = np.tile(1 / (1 + np.exp(21.5 - x)) - 1 / (1 + np.exp(80.5 - x)), (30, 1))
    assert steady.aperture_edges(a, (0.2, 0.8), 0.1) == pytest.approx((21.5, 80.5), abs=1e-3)
    assert np.isnan(steady.aperture_edges(a, (0.5, 0.8), 0.1)[0]) and np.isnan(steady.aperture_edges(a[:, :8], (0.5, 0.8), 0.1)[0])
    mean = np.ones((120, 200))
    mean[:, [14, 187]] = 0
    mean[[11, 109]] = 0
    assert steady.aperture_box(mean, (10, 190), (10, 110)) == (14, 11, 187, 109)
    wide = texture(100, 100, 3, 2.0)
    rolled = np.stack([wide, wide, np.roll(wide, 2, 1), wide])
    left, right, top, bottom = steady.border_shifts(rolled, 0.4, 8).T
    assert left[2] == pytest.approx(2, abs=0.4) and right[2] == pytest.approx(2, abs=0.4) and abs(top[0]) < 0.1 and abs(bottom[1]) < 0.1
    x = np.arange(1000)
    shifts = 2 * np.cos(2.0 * np.arange(9))
    lines = 100.0 * np.arange(1, 10)
    strip = np.tile(sum(np.exp(-(((x - c - s) / 3.0) ** 2)) for c, s in zip(lines, shifts, strict=True)), (5, 1))
    moved = steady.register_cuts(strip, lines, 100.0, (0, 5), sigma=0.1)
    assert np.abs(moved - lines - shifts + np.median(shifts)).max() < 0.1
    assert steady.register_cuts(strip, np.array([2.0]), 100.0, (0, 5)).tolist() == [2.0]


def test_template_borders():
    rng = np.random.default_rng(4)
    strip = 0.02 * rng.normal(size=(200, 1300))
    lines = 100.0 * np.arange(14)
    drift = np.arange(13)
    for k, d in enumerate(drift):
        strip[50 + d : 150 + d, 100 * k : 100 * k + 100] += 1
    b = frames.template_borders(strip, lines, (50 + drift[6], 150 + drift[6]), 12, reach=10)
    assert np.abs(b[:, 0] - 50 - drift).max() < 0.8 and np.abs(b[:, 1] - 150 - drift).max() < 0.8 and b[:, 2:].min() > 0.9
    assert np.isnan(frames.template_borders(strip[:, :80], np.array([0.0, 20, 40]), (50, 150), 12)).all()


def test_affine_and_histogram():
    t = texture(80, 80, 5, 2.0)
    y, x = np.mgrid[:80, :80] - 39.5
    a = steady.bilinear(t, 39.5 + 1.02 * x + 1, 39.5 + 0.99 * y - 2, outside=None)
    u, v = steady.align_affine(t, a, 4)
    before = gradient_correlation(*(steady.overlap(t, a, *(round(s) for s in steady.register(t, a)[:2]))))
    assert gradient_correlation(u[6:-6, 6:-6], v[6:-6, 6:-6]) > max(0.9, before)
    assert np.allclose(steady.match_histogram(np.array([[1.0, 2], [3, 4]]), np.array([[40.0, 10], [20, 30]])), [[10, 20], [30, 40]])
    assert steady.deform_spread(np.stack([t, t]), np.stack([t, t])) == pytest.approx((0, 0, 0), abs=1e-9)


def test_twins_merge():
    base = [np.full(96, 20.0 + 8 * k) for k in range(4)]
    t = walk.Tracker(1.0)
    for z in range(6):
        t.step(z, [*base, base[2] + 2.0] if z < 3 else base)
    assert t.merged(3.0) == {4: 2} and t.merged() == {}
    half = np.where(np.arange(96) < 48, 20.5, np.nan)
    t.step(9, [half, np.where(np.arange(96) < 48, np.nan, 60.0), np.full(96, np.nan)])
    assert t.merged(3.0)[4] == 2


def test_operators(spark):
    tile = texture(40, 48, 30).T
    f = spark.createDataFrame([(1, i, tile.ravel().tolist()) for i in range(16)], "reel int, i int, px array<double>")
    held = op.stabilise(f.where("i < 6"), ["reel"], "i", "px", (48, 40), angle=0.0).collect()
    assert len(held) == 6 and max(abs(r.dy) for r in held) < 0.1 and held[0].bottom > held[0].top
    assert op.locked_shifts(f, ["reel"], "i", "px", (48, 40)).count() == 16 and op.border_shifts(f, ["reel"], "i", "px", (48, 40)).count() == 16
    scores = op.variant_frames(f.where("i < 4").withColumn("px2", F.col("px")).withColumn("k", F.lit("a")), ["k", "i"], "px", "px2", (48, 40), grid=2)
    row = op.variant_summary(scores, ["k"], ["grad_corr", "ms_ssim"]).collect()[0]
    assert row.pairs == 4 and row.grad_corr == pytest.approx(1, abs=0.02)
    assert op.variant_summary(scores.limit(0), ["k"], ["grad_corr"]).count() == 0
