"""One- and two-dimensional signal kernels on NumPy arrays. No Spark here."""

from __future__ import annotations

import math

import numpy as np


def gaussian_taps(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    k = np.exp(-0.5 * (x / sigma) ** 2) if sigma > 0 else np.ones(1)
    return k / k.sum()


PADS = {"nearest": "edge", "wrap": "wrap", "reflect": "symmetric"}


def convolve1d(a: np.ndarray, taps: np.ndarray, mode: str = "reflect", axis: int = -1) -> np.ndarray:
    """Same-size convolution with a symmetric kernel along one axis; ``mode`` pads the ends."""
    r = len(taps) // 2
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r, r)
    padded = np.pad(a.astype(float), pad, PADS[mode])
    out = np.zeros(a.shape)
    n = a.shape[axis]
    for k, t in enumerate(taps):
        out += t * np.take(padded, np.arange(k, k + n), axis=axis)
    return out


def gaussian(a: np.ndarray, sigma: float, mode: str = "reflect") -> np.ndarray:
    """Gaussian filter over all axes."""
    taps = gaussian_taps(sigma)
    for axis in range(a.ndim):
        a = convolve1d(a, taps, mode, axis)
    return a


def moving_average(a: np.ndarray, taps: int) -> np.ndarray:
    return convolve1d(a, np.full(taps, 1 / taps), "nearest") if taps % 2 else convolve1d(a, np.full(taps + 1, 1 / (taps + 1)), "nearest")


def running_median(a: np.ndarray, size: int) -> np.ndarray:
    """Ends repeated as padding."""
    h = size // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(a, h, "edge"), size), axis=-1)


def fill_nan(a: np.ndarray) -> np.ndarray:
    """Missing values interpolated, held at the ends; all missing: zeros."""
    ok = np.isfinite(a)
    return np.interp(np.arange(len(a)), np.flatnonzero(ok), a[ok]) if ok.any() else np.zeros(len(a))


def fill_circular(a: np.ndarray, sigma: float) -> np.ndarray:
    """The same on a circle, then a circular Gaussian."""
    n = len(a)
    return convolve1d(fill_nan(np.tile(a, 3))[n : 2 * n], gaussian_taps(sigma), "wrap") if sigma else fill_nan(np.tile(a, 3))[n : 2 * n]


def fill_and_smooth(a: np.ndarray, sigma: float, limit: float = 4.0) -> np.ndarray:
    """Fill, drop what is further than ``limit`` scaled MADs from the 9-median, fill, smooth."""
    full = fill_nan(a)
    d = np.abs(full - running_median(full, 9))
    scale = 1.4826 * np.median(d)
    kept = np.where(d > limit * max(scale, 1e-12), np.nan, full)
    return convolve1d(fill_nan(kept), gaussian_taps(sigma), "nearest")


def robust_smooth(u: np.ndarray, y: np.ndarray, sigma: float, rounds: int = 3, limit: float = 3.0) -> np.ndarray:
    """Local lines with Gaussian weights, refitted with outliers by MAD left out."""
    w = np.isfinite(y).astype(float)
    y0 = np.where(np.isfinite(y), y, 0.0)
    out = np.zeros(len(y))
    for _ in range(rounds):
        for i, c in enumerate(u):
            d = u - c
            k = w * np.exp(-0.5 * (d / sigma) ** 2)
            s0, s1, s2 = k.sum(), (k * d).sum(), (k * d * d).sum()
            t0, t1 = (k * y0).sum(), (k * d * y0).sum()
            det = s0 * s2 - s1 * s1
            out[i] = (s2 * t0 - s1 * t1) / det if det > 1e-12 * max(s0, 1) ** 2 else t0 / s0 if s0 else np.nan
        r = np.abs(y0 - out)
        scale = 1.4826 * np.median(r[w > 0]) if (w > 0).any() else 0
        w = (np.isfinite(y) & (r <= limit * max(scale, 1e-12))).astype(float)
    return out


# ---- peaks


def peaks(a: np.ndarray, distance: float = 1, prominence: float = 0.0) -> np.ndarray:
    """Local maxima (a plateau's middle), thinned from the highest down so that none is nearer
    than ``distance`` to a kept one, whose prominence reaches the given one."""
    n = len(a)
    start = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), a[1:] != a[:-1]]))  # of runs of equal samples
    end = np.append(start[1:], n) - 1
    inner = (start > 0) & (end < n - 1)
    start, end = start[inner], end[inner]
    high = (a[start] > a[start - 1]) & (a[end + 1] < a[start])
    at = (start[high] + end[high]) // 2
    if distance > 1 and len(at):
        reach = math.ceil(distance) - 1
        lo, hi = np.searchsorted(at, at - reach, "left").tolist(), np.searchsorted(at, at + reach, "right").tolist()
        keep = bytearray(b"\1" * len(at))
        for k in np.argsort(-a[at], kind="stable").tolist():
            if keep[k]:
                keep[lo[k] : hi[k]] = bytes(hi[k] - lo[k])
                keep[k] = 1
        at = at[np.frombuffer(keep, np.uint8) > 0]
    if prominence > 0:
        at = at[[_prominence(a, p) >= prominence for p in at]] if len(at) else at
    return at


def _prominence(a: np.ndarray, p: int) -> float:
    left = right = a[p]
    for k in range(p - 1, -1, -1):
        if a[k] > a[p]:
            break
        left = min(left, a[k])
    for k in range(p + 1, len(a)):
        if a[k] > a[p]:
            break
        right = min(right, a[k])
    return float(a[p] - max(left, right))


def parabola(a: float, b: float, c: float) -> float:
    bend = a - 2 * b + c
    return 0.0 if bend == 0 else float(np.clip(0.5 * (a - c) / bend, -1, 1))


def top_separated(score: np.ndarray, at: np.ndarray, k: int, apart: float, period: float = 360.0) -> list[int]:
    """Up to k indices of the largest magnitudes, no two nearer than ``apart`` on the circle."""
    out: list[int] = []
    for i in np.argsort(-np.abs(score), kind="stable"):
        if all(abs((at[i] - at[j] + period / 2) % period - period / 2) >= apart for j in out):
            out.append(int(i))
        if len(out) == k:
            break
    return out


def valley_boundaries(radii: np.ndarray, smooth: float, distance: float, share: float, per_length: bool = False) -> np.ndarray:
    """valleys() of a histogram of radii in bins of 1 from 0."""
    return valleys(np.bincount(np.floor(radii).astype(int)).astype(float), smooth, distance, share, per_length)


def valleys(h: np.ndarray, smooth: float, distance: float, share: float, per_length: bool = False) -> np.ndarray:
    """Valleys of smoothed counts: at least ``distance`` apart, with a prominence of ``share`` of the
    largest count; counts may be taken per circumference."""
    if per_length:
        h = h / (2 * np.pi * np.maximum(np.arange(len(h)), 1))
    s = convolve1d(h, gaussian_taps(smooth))
    return peaks(-s, distance, share * s.max() if len(s) else 0)


# ---- pitch and phase


def autocorrelation(a: np.ndarray) -> np.ndarray:
    n = len(a)
    f = np.fft.rfft(a - a.mean(), 2 * n)
    return np.fft.irfft(f * f.conj())[:n]


def estimate_pitch(a: np.ndarray, lo: int, hi: int, smooth: int = 1) -> float:
    """The lag of the largest autocorrelation in [lo, hi]; a third or half of it instead, if that
    lag is in range and holds 0.7 of the peak."""
    r = autocorrelation(moving_average(a, smooth) if smooth > 1 else a)
    hi = min(hi, len(r) - 2)
    best = lo + int(np.argmax(r[lo : hi + 1]))
    for d in (3, 2):
        c = round(best / d)
        if c >= lo:
            near = np.arange(max(lo, c - 3), min(hi, c + 3) + 1)
            k = near[np.argmax(r[near])]
            if r[k] >= 0.7 * r[best]:
                best = int(k)
                break
    return best + parabola(r[best - 1], r[best], r[best + 1])


def refine_pitch(a: np.ndarray, pitch: float) -> float:
    """The highest multiple of the pitch that still shows in the autocorrelation, over its count."""
    r = autocorrelation(a)
    k = max(1, int(0.5 * len(a) / pitch))
    while True:
        c, w = k * pitch, max(2.0, 0.15 * pitch)
        lo, hi = max(1, int(c - w)), min(len(r) - 2, int(c + w))
        if hi > lo:
            j = lo + int(np.argmax(r[lo : hi + 1]))
            if lo < j < hi or k == 1:
                return (j + parabola(r[j - 1], r[j], r[j + 1])) / k
        k -= 1


def bandpass(a: np.ndarray, pitch: float, width: float = 0.25) -> np.ndarray:
    """The part of a signal whose frequency is within ``width`` of 1 / pitch."""
    f = np.fft.rfft(a - a.mean())
    freq = np.fft.rfftfreq(len(a))
    f[np.abs(freq - 1 / pitch) > width / pitch] = 0
    return np.fft.irfft(f, len(a))


def analytic(a: np.ndarray) -> np.ndarray:
    """The analytic signal, by FFT."""
    n = len(a)
    f = np.fft.fft(a)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(f * h)


def phase_pitch(a: np.ndarray, pitch: float) -> float:
    """The pitch from the slope of the unwrapped phase between 8 and 92 percent of the length."""
    phase = np.unwrap(np.angle(analytic(bandpass(a, pitch))))
    lo, hi = int(0.08 * len(a)), int(0.92 * len(a))
    return float(2 * np.pi / np.polyfit(np.arange(lo, hi), phase[lo:hi], 1)[0])


def boundaries(a: np.ndarray, pitch: float, dark: bool = False) -> np.ndarray:
    """Peaks of the periodic part, at least 0.6 of the pitch apart."""
    b = bandpass(-a if dark else a, pitch)
    return peaks(b, 0.6 * pitch)


def tracked_boundaries(a: np.ndarray, pitch: float, sigma_cells: float = 2.0) -> np.ndarray:
    """Places where the smoothed, never falling phase passes whole turns; amplitudes under a
    fifth of the median do not count."""
    z = analytic(bandpass(a, pitch))
    phase = np.unwrap(np.angle(z)) / (2 * np.pi)
    trust = np.abs(z) >= 0.2 * np.median(np.abs(z))
    x = np.arange(len(a))
    excess = phase - x / pitch
    steps = np.diff(excess, prepend=excess[0])
    excess = excess - np.cumsum(np.rint(steps))
    excess = np.interp(x, x[trust], excess[trust])
    turns = np.maximum.accumulate(x / pitch + convolve1d(excess, gaussian_taps(sigma_cells * pitch), "nearest"))
    whole = np.arange(np.ceil(turns[0]), np.floor(turns[-1]) + 1)
    return np.interp(whole, turns, x)


def phase_lock(a: np.ndarray, pitch: float) -> np.ndarray:
    """Evenly spaced bounds at the offset of the largest mean."""
    offsets = np.arange(int(np.ceil(pitch)))
    mean = [a[np.minimum(np.rint(np.arange(o, len(a) - 1e-9, pitch)).astype(int), len(a) - 1)].mean() for o in offsets]
    return np.arange(offsets[int(np.argmax(mean))], len(a), pitch)


# ---- shifts


def shift1d(ref: np.ndarray, sig: np.ndarray, limit: int) -> tuple[float, float]:
    """How far ``sig`` lies behind ``ref``, by normalised correlation over lags up to ``limit``,
    between samples, and the correlation there; NaN if the best lag is an end."""
    best = []
    n = len(ref)
    for lag in range(-limit, limit + 1):
        a, b = (ref[: n - lag], sig[lag:]) if lag >= 0 else (ref[-lag:], sig[: n + lag])
        a, b = a - a.mean(), b - b.mean()
        d = np.sqrt((a * a).sum() * (b * b).sum())
        best.append((a * b).sum() / d if d > 0 else 0.0)
    k = int(np.argmax(best))
    if k in (0, 2 * limit):
        return float("nan"), float(best[k])
    return k - limit + parabola(*best[k - 1 : k + 2]), float(best[k])


def phase_correlation(a: np.ndarray, b: np.ndarray, limit: tuple[int, ...] | None = None, sub: bool = False) -> tuple[float, ...]:
    """The shift of ``b`` against ``a`` (any number of axes) from the peak of the normalised cross
    spectrum; bounded per axis; between samples by a parabola with ``sub``."""
    f = np.fft.fftn(b - b.mean()) * np.fft.fftn(a - a.mean()).conj()
    r = np.fft.ifftn(f / np.maximum(np.abs(f), 1e-12)).real
    free = np.ones(r.shape, bool)
    for axis, n in enumerate(r.shape):
        s = (np.arange(n) + n // 2) % n - n // 2
        ok = np.abs(s) <= (limit[axis] if limit else n)
        free &= ok.reshape([-1 if k == axis else 1 for k in range(r.ndim)])
    at = np.unravel_index(int(np.argmax(np.where(free, r, -np.inf))), r.shape)
    out = []
    for axis, n in enumerate(r.shape):
        s = (at[axis] + n // 2) % n - n // 2
        if sub and n > 2:
            near = [r[tuple(((at[k] + d) % r.shape[k]) if k == axis else at[k] for k in range(r.ndim))] for d in (-1, 0, 1)]
            s = s + parabola(*near)
        out.append(float(s))
    return tuple(out)


def circular_shift(a: np.ndarray, b: np.ndarray, limit: int | None = None) -> int:
    """The roll of ``b`` that fits ``a`` best."""
    r = np.fft.irfft(np.fft.rfft(a - a.mean()) * np.fft.rfft(b - b.mean()).conj(), len(a))
    s = (np.arange(len(a)) + len(a) // 2) % len(a) - len(a) // 2
    r[np.abs(s) > (len(a) if limit is None else limit)] = -np.inf
    return int(s[np.argmax(r)])


def ncc_peak(a: np.ndarray, b: np.ndarray) -> float:
    """The largest circular normalised cross-correlation of two images."""
    a, b = a - a.mean(), b - b.mean()
    d = np.sqrt((a * a).sum() * (b * b).sum())
    return float(np.fft.ifft2(np.fft.fft2(a) * np.fft.fft2(b).conj()).real.max() / d) if d > 0 else 0.0


def lock_axis(profiles: np.ndarray, limit: int, rounds: int = 3) -> np.ndarray:
    """Shifts of profiles against their common median, found again with moved profiles; unsound
    ones interpolated; the mean shift is 0."""
    n = profiles.shape[1]
    total = np.zeros(len(profiles))
    moved = profiles
    for _ in range(rounds):
        ref = np.median(moved, axis=0)
        total += fill_nan(np.array([shift1d(ref, p, limit)[0] for p in moved]))
        total -= total.mean()
        moved = np.stack([np.interp(np.arange(n) + s, np.arange(n), p) for p, s in zip(profiles, total, strict=True)])
    return total


def drift(strip: np.ndarray, window: int, step: int, limit: int, smooth: float, rounds: int = 2) -> np.ndarray:
    """The slow sway of a strip's rows along its columns: windowed row profiles locked together,
    interpolated to every column and smoothed."""
    starts = np.arange(0, max(1, strip.shape[1] - window + 1), step)
    profiles = np.stack([strip[:, s : s + window].mean(axis=1) for s in starts])
    found = lock_axis(profiles, limit, rounds)
    full = np.interp(np.arange(strip.shape[1]), starts + window / 2, found)
    return convolve1d(full, gaussian_taps(smooth), "nearest") if smooth else full


# ---- alignment in sequence


def dtw(a: np.ndarray, b: np.ndarray, band: float = 0.1) -> list[tuple[int, int]]:
    """Dynamic time warping of rows under 1 - cosine within a band around the diagonal; going
    back, the diagonal comes first on ties.

    Sums are made a cross diagonal (i + j the same) at a time. Two of them are kept now and then, and
    going back, what lies between is made again near the path alone: of n rows, memory grows with
    n ** 1.5, and with n times the rows' width, but not with n ** 2."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    u, v = unit(a), np.ascontiguousarray(unit(b)[::-1])
    n, m = len(u), len(v)
    half = max(int(np.ceil(band * max(n, m))), 1)
    row = np.arange(n)
    mid = np.rint(row * (m - 1) / max(1, n - 1)).astype(np.int64)
    d = np.arange(n + m - 1)
    first = np.searchsorted(row + np.minimum(m - 1, mid + half), d, "left")
    last = np.searchsorted(row + np.maximum(0, mid - half), d, "right") - 1
    every = max(16, math.isqrt(n + m))

    def sweep(before: list[np.ndarray], start: int, stop: int, low: int, high: int):
        """Sums of diagonals ``start`` to ``stop`` (exclusive) in rows ``low`` to ``high``, from the two
        before; row i stands at i + 1 - low, those out of the band are infinite."""
        older, old = before
        for k in range(start, stop):
            new = np.full(high - low + 2, np.inf)
            p, q = max(first[k], low), min(last[k], high)
            if p <= q:
                near = np.minimum(np.minimum(older[p - low : q - low + 1], old[p - low : q - low + 1]), old[p - low + 1 : q - low + 2])
                new[p - low + 1 : q - low + 2] = (1 - np.vecdot(u[p : q + 1], v[m - 1 - k + p : m - k + q])) + near
            yield new
            older, old = old, new

    nothing = np.full(n + 1, np.inf)
    origin = nothing.copy()
    origin[0] = 0
    kept, lows = [], []
    pair = [origin, nothing]
    for k in range(0, n + m - 1, every):
        low, high = int(first[max(k - 2, 0)]), int(last[max(k - 1, 0)])
        kept.append([x[low : high + 2].copy() for x in pair])
        lows.append(low)
        for new in sweep(pair, k, min(k + every, n + m - 1), 0, n - 1):
            pair = [pair[1], new]
    i, j, path = n - 1, m - 1, []
    for block in range(len(kept) - 1, -1, -1):
        k = block * every
        if i < 0 or j < 0 or i + j < k:
            continue
        low, high = max(0, i - every - 2), i
        pair = []
        for x in kept[block]:
            whole = np.full(high - low + 2, np.inf)
            p, q = max(low, lows[block]), min(high + 1, lows[block] + len(x) - 1)
            if p <= q:
                whole[p - low : q - low + 1] = x[p - lows[block] : q - lows[block] + 1]
            pair.append(whole)
        sums = [*pair, *sweep(pair, k, i + j + 1, low, high)]
        at = lambda r, c: sums[r + c - k + 2][r + 1 - low]
        while i >= 0 and j >= 0 and i + j >= k:
            path.append((i, j))
            options = ((at(i - 1, j - 1), i - 1, j - 1), (at(i - 1, j), i - 1, j), (at(i, j - 1) if j else np.inf, i, j - 1))
            _, i, j = min(options, key=lambda x: x[0])
    return path[::-1]


def viterbi(score: np.ndarray, penalty: float) -> np.ndarray:
    """The path over states (columns) of the largest score less ``penalty`` for each unit of change."""
    n, m = score.shape
    move = penalty * np.abs(np.arange(m)[:, None] - np.arange(m)[None])
    best, back = score[0].astype(float), np.zeros((n, m), np.int64)
    for t in range(1, n):
        via = best[None] - move
        back[t] = np.argmax(via, axis=1)
        best = via[np.arange(m), back[t]] + score[t]
    path = np.zeros(n, np.int64)
    path[-1] = int(np.argmax(best))
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def frame_viterbi(score: np.ndarray, repeat: float, skip: float) -> np.ndarray:
    """Frames matched to rising indices: the next index is free, the same and the one after that
    cost ``repeat`` and ``skip``."""
    n, m = score.shape
    best, back = score[0].astype(float), np.zeros((n, m), np.int64)
    for t in range(1, n):
        options = np.full((3, m), -np.inf)
        options[0, 1:] = best[:-1]
        options[1] = best - repeat
        options[2, 2:] = best[:-2] - skip
        pick = np.argmax(options, axis=0)
        back[t] = np.arange(m) - np.array([1, 0, 2])[pick]
        best = options[pick, np.arange(m)] + score[t]
    path = np.zeros(n, np.int64)
    path[-1] = int(np.argmax(best))
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def coarse_to_fine(score, centre: float, radius: float, step: float) -> tuple[float, float]:
    """The best place of a score in [centre - radius, centre + radius]: by steps, then by ones."""
    coarse = np.arange(centre - radius, centre + radius + 1e-9, step)
    c = coarse[int(np.argmax([score(x) for x in coarse]))]
    fine = np.arange(max(centre - radius, c - step), min(centre + radius, c + step) + 1e-9, 1.0)
    values = [score(x) for x in fine]
    k = int(np.argmax(values))
    return float(fine[k]), float(values[k])


# ---- fits


def polyfit_robust(x: np.ndarray, y: np.ndarray, degree: int, rounds: int = 5) -> np.ndarray:
    """Iteratively reweighted least squares with Cauchy weights."""
    w = np.ones(len(x))
    for _ in range(rounds):
        c = np.polyfit(x, y, degree, w=np.sqrt(w))
        r = y - np.polyval(c, x)
        s = max(1.4826 * np.median(np.abs(r)), 1e-12)
        w = 1 / (1 + (r / (2.385 * s)) ** 2)
    return c


def fourier_fit(theta: np.ndarray, y: np.ndarray, harmonics: int, rounds: int = 5) -> np.ndarray:
    """The same for a constant and harmonics: c0, a1, b1, a2, b2, ..."""
    a = fourier_basis(theta, harmonics)
    w = np.ones(len(y))
    for _ in range(rounds):
        k = np.sqrt(w)[:, None]
        c = np.linalg.lstsq(a * k, y * k[:, 0], rcond=None)[0]
        r = y - a @ c
        s = max(1.4826 * np.median(np.abs(r)), 1e-12)
        w = 1 / (1 + (r / (2.385 * s)) ** 2)
    return c


def fourier_basis(theta: np.ndarray, harmonics: int) -> np.ndarray:
    return np.stack([np.ones(len(theta))] + [f(k * theta) for k in range(1, harmonics + 1) for f in (np.cos, np.sin)], 1)


def affine_fit(p: np.ndarray, d: np.ndarray, rounds: int = 3) -> np.ndarray:
    """The affine field (3 x 2) of displacements d at places p, robust."""
    a = np.column_stack([np.ones(len(p)), p])
    w = np.ones(len(p))
    for _ in range(rounds):
        k = np.sqrt(w)[:, None]
        c = np.linalg.lstsq(a * k, d * k, rcond=None)[0]
        r = np.linalg.norm(d - a @ c, axis=1)
        s = max(1.4826 * np.median(r), 1e-12)
        w = 1 / (1 + (r / s) ** 2)
    return c


def penalised_spline(x: np.ndarray, y: np.ndarray, smooth: float, knots: int = 40):
    """A cubic B-spline with a second-difference penalty such that the mean squared residual comes
    near ``smooth`` squared; returns a function."""
    order = np.argsort(x, kind="stable")
    xs, where = np.unique(x[order], return_inverse=True)
    n = np.bincount(where)
    ys = np.bincount(where, y[order]) / n
    lo, hi = xs[0], xs[-1] if xs[-1] > xs[0] else xs[0] + 1
    k = int(min(knots, max(1, len(xs) - 1)))
    width = (hi - lo) / k

    def basis(v: np.ndarray) -> np.ndarray:
        t = np.clip((np.asarray(v, float) - lo) / width, 0, k - 1e-9)
        i = np.minimum(t.astype(int), k - 1)
        f = t - i
        b = np.zeros((len(t), k + 3))
        for j, c in enumerate(((1 - f) ** 3 / 6, (3 * f**3 - 6 * f**2 + 4) / 6, (-3 * f**3 + 3 * f**2 + 3 * f + 1) / 6, f**3 / 6)):
            b[np.arange(len(t)), i + j] += c
        return b

    b, p = basis(xs), np.diff(np.eye(k + 3), 2, axis=0)
    g, t, pp = (b * n[:, None]).T @ b, (b * n[:, None]).T @ ys, p.T @ p
    best = None
    for lam in 10.0 ** np.arange(-6, 7):
        c = np.linalg.solve(g + lam * pp + 1e-9 * np.eye(k + 3), t)
        mse = float(((ys - b @ c) ** 2 * n).sum() / n.sum())
        if best is None or mse <= smooth**2:
            best = c
    return lambda v: basis(np.atleast_1d(v)) @ best


def tridiagonal(lower: np.ndarray, diag: np.ndarray, upper: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solve a tridiagonal system by elimination."""
    n = len(diag)
    c, d = np.zeros(n), np.zeros(n)
    c[0], d[0] = upper[0] / diag[0] if n > 1 else 0, rhs[0] / diag[0]
    for i in range(1, n):
        m = diag[i] - lower[i - 1] * c[i - 1]
        c[i] = upper[i] / m if i < n - 1 else 0
        d[i] = (rhs[i] - lower[i - 1] * d[i - 1]) / m
    for i in range(n - 2, -1, -1):
        d[i] -= c[i] * d[i + 1]
    return d


def invert_lerp(u: np.ndarray, v: np.ndarray, n: int, ridge: float = 0.01) -> np.ndarray:
    """Samples of a signal at 0 .. n - 1 from values v read between them at places u: regularised
    normal equations, which are tridiagonal."""
    i = np.clip(np.floor(u).astype(int), 0, n - 2)
    f = u - i
    diag = np.bincount(i, (1 - f) ** 2, n) + np.bincount(i + 1, f**2, n) + ridge * 2
    off = np.bincount(i, f * (1 - f), n)[: n - 1] - ridge
    rhs = np.bincount(i, (1 - f) * v, n) + np.bincount(i + 1, f * v, n)
    diag[[0, -1]] -= ridge
    return tridiagonal(off, diag + 1e-9, off, rhs)
