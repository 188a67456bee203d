import tracemalloc

import numpy as np
import pytest

from lamina.kernels import image, signal, walk


def test_gaussian_keeps_constants_and_linear_ramps():
    assert np.allclose(signal.gaussian(np.full((9, 7), 3.0), 1.3), 3.0)
    ramp = np.arange(60.0)
    assert np.allclose(signal.convolve1d(ramp, signal.gaussian_taps(2), "nearest")[10:-10], ramp[10:-10])
    assert np.allclose(signal.convolve1d(np.eye(1, 30, 3)[0], signal.gaussian_taps(1.5), "wrap").sum(), 1)


def test_running_median_and_fill():
    a = np.array([1.0, 9, 2, 3, 4])
    assert signal.running_median(a, 3).tolist() == [1, 2, 3, 3, 4]
    assert signal.fill_nan(np.array([np.nan, 1, np.nan, 3, np.nan])).tolist() == [1, 1, 2, 3, 3]
    assert signal.fill_nan(np.full(3, np.nan)).tolist() == [0, 0, 0]
    y = np.sin(np.arange(200) / 30)
    bad = y.copy()
    bad[[40, 120]] += 5
    bad[77] = np.nan
    assert np.abs(signal.fill_and_smooth(bad, 2.0) - y).max() < 0.1


def test_peaks():
    a = np.array([0, 2, 0, 1, 1, 0, 5, 0, 3.0, 0])
    assert signal.peaks(a).tolist() == [1, 3, 6, 8]
    assert signal.peaks(a, distance=3).tolist() == [1, 6]
    assert signal.peaks(a, prominence=2).tolist() == [1, 6, 8]


@pytest.mark.parametrize("pitch", [37.0, 52.4])
def test_pitch(pitch):
    x = np.arange(4000)
    a = np.cos(2 * np.pi * x / pitch) + 0.3 * np.cos(4 * np.pi * x / pitch) + 0.05 * np.random.default_rng(0).normal(size=4000)
    p = signal.estimate_pitch(a, 20, 200)
    assert abs(p - pitch) < 0.6
    assert abs(signal.refine_pitch(a, p) - pitch) < 0.05
    assert abs(signal.phase_pitch(a, p) - pitch) < 0.2
    b = signal.tracked_boundaries(a, pitch)
    assert np.abs(np.diff(b)[3:-3] - pitch).max() < 1.5
    assert abs(len(signal.phase_lock(a, pitch)) - 4000 / pitch) <= 1


@pytest.mark.parametrize("shift", [(3, -2), (0, 0), (-4, 5)])
def test_shifts_of_images(shift):
    a = np.random.default_rng(1).normal(size=(32, 40))
    assert signal.phase_correlation(a, np.roll(a, shift, (0, 1)), (8, 8)) == shift
    assert image.match_score(image.gaussian(a, 1), image.gaussian(np.roll(a, shift, (0, 1)), 1), (8, 8)) > 0.9


def test_shifts_of_profiles():
    x = np.arange(120.0)
    f = lambda s: np.exp(-(((x - 60 - s) / 6) ** 2)) + 0.5 * np.exp(-(((x - 30 - s) / 3) ** 2))
    s, c = signal.shift1d(f(0), f(2.5), 10)
    assert abs(s - 2.5) < 0.1 and c > 0.95
    assert np.isnan(signal.shift1d(f(0), f(20), 10)[0])
    assert signal.circular_shift(np.roll(f(0), 7), f(0)) == 7
    moved = np.stack([f(s) for s in (0, 1, -1, 2, -2)])
    assert np.abs(signal.lock_axis(moved, 6) - np.array([0, 1, -1, 2, -2])).max() < 0.3


def brute_dtw(cost):
    n, m = cost.shape
    best = np.full((n + 1, m + 1), np.inf)
    best[0, 0] = 0
    for i in range(n):
        for j in range(m):
            best[i + 1, j + 1] = cost[i, j] + min(best[i, j], best[i, j + 1], best[i + 1, j])
    return best[n, m]


def test_dtw_and_viterbi():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(7, 5)), rng.normal(size=(9, 5))
    path = signal.dtw(a, b, 1.0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    cost = 1 - unit(a) @ unit(b).T
    assert path[0] == (0, 0) and path[-1] == (6, 8)
    assert abs(sum(cost[i, j] for i, j in path) - brute_dtw(cost)) < 1e-9
    s = rng.normal(size=(6, 4))
    import itertools

    value = lambda p: sum(s[t, k] for t, k in enumerate(p)) - 0.4 * sum(abs(x - y) for x, y in zip(p, p[1:], strict=False))
    assert abs(value(signal.viterbi(s, 0.4)) - max(map(value, itertools.product(range(4), repeat=6)))) < 1e-9


def test_fits():
    x = np.linspace(0, 1, 80)
    y = 2 * x**2 - x + 0.5
    y[::9] += 4
    assert np.allclose(signal.polyfit_robust(x, y, 2, 20), [2, -1, 0.5], atol=0.05)
    t = np.linspace(0, 6, 100)
    assert np.allclose(signal.fourier_fit(t, 1 + 2 * np.cos(t) - np.sin(2 * t), 2), [1, 2, 0, 0, -1], atol=1e-6)
    f = signal.penalised_spline(t, np.sin(t), 0.01)
    assert np.abs(f(t) - np.sin(t)).max() < 0.05
    true = np.sin(np.arange(30) / 4)
    u = np.random.default_rng(3).uniform(0, 29, 600)
    v = np.interp(u, np.arange(30), true)
    assert np.abs(signal.invert_lerp(u, v, 30, 1e-4) - true).max() < 0.01
    p = np.random.default_rng(4).uniform(0, 9, (40, 2))
    d = np.column_stack([np.ones(40), p]) @ np.array([[1, 2], [0.1, 0], [0, -0.2]])
    d[:4] += 7
    assert np.allclose(signal.affine_fit(p, d, 20), [[1, 2], [0.1, 0], [0, -0.2]], atol=0.05)


def flood(mask):
    lab, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not lab[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                i, j = todo.pop()
                if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and not lab[i, j]:
                    lab[i, j] = n
                    todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    return lab, n


def test_components_against_flooding():
    for seed in range(8):
        m = np.random.default_rng(seed).random((17, 23)) < 0.55
        a, b = image.components(m), flood(m)
        assert a[1] == b[1] and len({(x, y) for x, y in zip(a[0].ravel(), b[0].ravel(), strict=True)}) == a[1] + (not m.all())
    assert image.components(np.zeros((3, 3), bool))[1] == 0


def test_images():
    a = np.random.default_rng(5).random((40, 40))
    assert image.ssim(a, a) == pytest.approx(1) and image.multi_scale_ssim(a, a) == pytest.approx(1)
    assert image.gradient_correlation(a, a) == pytest.approx(1) and np.isnan(image.gradient_correlation(a, np.ones((40, 40))))
    assert image.bilinear(a, np.array([3.0, -1]), np.array([4.0, 2])).tolist() == [a[4, 3], 0]
    assert image.bicubic(a, np.array([3.0]), np.array([4.0]))[0] == pytest.approx(a[4, 3])
    turned = np.rot90(a, 3)
    assert image.best_orientation(a, turned)[:2] == (1, False)
    assert image.geodesic(np.ones((3, 3), bool), (0, 0))[2, 2] == pytest.approx(2 * 2**0.5)
    box = np.zeros((30, 30))
    box[12:17, 10:17] = 1
    m = image.box_match(box, 2, 3, 4)
    assert np.unravel_index(m.argmax(), m.shape) == (14, 13)
    ring = np.ones((41, 41), int)
    y, x = np.mgrid[:41, :41]
    ring[np.hypot(x - 22, y - 19) < 6] = 0
    assert np.allclose(image.centre_of_hole(ring), (22, 19))


def spiral(size=160, windings=4, r0=24.0, pitch=11.0, thick=5.0, gap=None):
    c = (size - 1) / 2
    y, x = np.mgrid[:size, :size]
    r, t = np.hypot(x - c, y - c), np.arctan2(y - c, x - c) % (2 * np.pi)
    k = np.rint((r - r0 - pitch * t / (2 * np.pi)) / pitch)
    on = (k >= 0) & (k < windings) & (np.abs(r - r0 - pitch * (t / (2 * np.pi) + k)) <= thick / 2)
    return on & ~((k == 1) & (t > 2) & (t < 2.4)) if gap else on, c


@pytest.mark.parametrize("gap", [None, True])
def test_trace_finds_every_winding(gap):
    mask, c = spiral(gap=gap)
    paths = walk.trace(mask, c, c, 19, 79, 0.0)
    assert len(paths) == 4
    for k, p in enumerate(paths):
        phi, r = walk.azimuth_from(p, c, c, 0.0), np.hypot(*(p - c).T)
        assert np.ptp(phi) > 6 and np.median(np.abs(r - 24 - 11 * (phi / (2 * np.pi) + k))) < 0.3


def test_seam_and_bare_bands():
    mask, c = spiral(size=230, windings=7)
    assert np.sin(walk.seam_azimuth(mask, c, c, 19, 110)) < 0.2
    paths = walk.trace(mask, c, c, 19, 110, 0.0)
    assert len(paths) == 7 and len(walk.bare_bands([p for k, p in enumerate(paths) if k != 3], mask, c, c, 0.0)) == 1


def test_tracker():
    base = [np.full(96, 20.0 + 8 * k) for k in range(5)]
    t, ids = walk.Tracker(3.0), []
    for z in range(12):
        walks = [b + 0.3 * z for k, b in enumerate(base) if not (k == 2 and 4 <= z < 7)]
        got = t.step(z, walks)
        ids.append(got)
    assert all(x == [0, 1, 2, 3, 4] for x in ids[:4] + ids[7:]) and ids[5] == [0, 1, 3, 4]
    assert walk.dedup_by_spacing(np.array([10.0, 11, 20]), np.array([5, 9, 3]), 4) == [1, 2]
    tracks = walk.radius_tracks({0: [10.0, 20], 1: [10.5, 20.4, 40], 2: [11, 21, 40.2]})
    assert sorted(len(x) for x in tracks) == [2, 3, 3]


def table_dtw(a, b, band):
    """The whole table of sums, cell by cell."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    cost = 1 - np.vecdot(unit(a)[:, None], unit(b)[None])
    n, m = cost.shape
    half = max(int(np.ceil(band * max(n, m))), 1)
    best = np.full((n + 1, m + 1), np.inf)
    best[0, 0] = 0
    for i in range(n):
        mid = round(i * (m - 1) / max(1, n - 1))
        for j in range(max(0, mid - half), min(m - 1, mid + half) + 1):
            best[i + 1, j + 1] = cost[i, j] + min(best[i, j], best[i, j + 1], best[i + 1, j])
    i, j, path = n, m, []
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda x: best[x])
    return path[::-1]


def test_dtw_in_blocks_is_that_of_the_table():
    """Also with repeated rows, where the diagonal comes first, and bands that leave gaps."""
    r = np.random.default_rng(3)
    for n, m, band, repeated in [(1, 1, 0.1, False), (1, 40, 0.1, False), (40, 1, 0.1, False), (70, 90, 0.1, False), (90, 70, 0.3, False), (80, 80, 0.2, True), (9, 150, 0.001, False), (150, 9, 0.001, True), (60, 60, 1.0, True)]:
        pool = r.normal(size=(5 if repeated else 200, 4))
        a, b = pool[r.integers(0, len(pool), n)], pool[r.integers(0, len(pool), m)]
        assert signal.dtw(a, b, band) == table_dtw(a, b, band), (n, m, band)


def test_dtw_memory():
    a, b = np.random.default_rng(4).normal(size=(2, 1000, 4))
    tracemalloc.start()
    signal.dtw(a, b, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # a table of sums has 8 MB
