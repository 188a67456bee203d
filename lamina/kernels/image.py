"""Image kernels on NumPy arrays: filters, similarity, morphology, sampling. No Spark here."""

from __future__ import annotations

import heapq

import numpy as np

from lamina.kernels.signal import convolve1d, gaussian, gaussian_taps, phase_correlation


def sobel(a: np.ndarray) -> np.ndarray:
    """Gradient magnitude."""
    d, s = np.array([-1.0, 0, 1]), np.array([1.0, 2, 1])
    return np.hypot(convolve1d(convolve1d(a, d, "reflect", 1), s, "reflect", 0), convolve1d(convolve1d(a, d, "reflect", 0), s, "reflect", 1))


def unit_range(a: np.ndarray) -> np.ndarray:
    span = a.max() - a.min()
    return (a - a.min()) / span if span > 0 else np.zeros(a.shape)


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    """NaN where a variance vanishes."""
    a, b = a.ravel() - a.mean(), b.ravel() - b.mean()
    d = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / d) if d > 1e-12 else float("nan")


def gradient_correlation(a: np.ndarray, b: np.ndarray) -> float:
    return pearson(sobel(a), sobel(b))


def local_contrast(a: np.ndarray, sigma: float = 6.0) -> np.ndarray:
    """Less the local mean, over the local deviation."""
    m = gaussian(a, sigma)
    return (a - m) / np.sqrt(np.maximum(gaussian(a * a, sigma) - m * m, 0) + 1e-6)


def ssim(a: np.ndarray, b: np.ndarray, sigma: float = 1.5, top: float = 1.0) -> float:
    """Mean structural similarity under a Gaussian window."""
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    ma, mb = gaussian(a, sigma), gaussian(b, sigma)
    va, vb, cov = gaussian(a * a, sigma) - ma**2, gaussian(b * b, sigma) - mb**2, gaussian(a * b, sigma) - ma * mb
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def halve(a: np.ndarray) -> np.ndarray:
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    return a[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))


def multi_scale_ssim(a: np.ndarray, b: np.ndarray, scales: int = 4, sigma: float = 1.5) -> float:
    """Geometric mean of whole SSIMs over halved images of at least 16 pixels."""
    logs = []
    for _ in range(scales):
        logs.append(np.log(max(ssim(a, b, sigma), 1e-6)))
        if min(a.shape) < 32:
            break
        a, b = halve(a), halve(b)
    return float(np.exp(np.mean(logs)))


def embedding(a: np.ndarray, size: int = 32) -> np.ndarray:
    """Gradient magnitude on a small grid, without mean, of unit length."""
    g = sobel(resize(a, size, size)).ravel()
    g = g - g.mean()
    return g / max(np.linalg.norm(g), 1e-12)


def high_frequency_share(a: np.ndarray, top: float = 0.25) -> float:
    """Share of the rows' spectral power in the highest frequencies."""
    p = np.abs(np.fft.rfft(a - a.mean(axis=1, keepdims=True), axis=1)) ** 2
    cut = int(np.ceil(p.shape[1] * (1 - top)))
    return float(p[:, cut:].sum() / max(p.sum(), 1e-12))


def bilinear(a: np.ndarray, x: np.ndarray, y: np.ndarray, outside: float | None = 0.0) -> np.ndarray:
    """Values between pixels; beyond the image ``outside``, or its nearest pixel for None."""
    h, w = a.shape
    cx, cy = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    i, j = np.minimum(cy.astype(int), max(h - 2, 0)), np.minimum(cx.astype(int), max(w - 2, 0))
    fy, fx = cy - i, cx - j
    i1, j1 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    v = (1 - fy) * ((1 - fx) * a[i, j] + fx * a[i, j1]) + fy * ((1 - fx) * a[i1, j] + fx * a[i1, j1])
    return v if outside is None else np.where((x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1), v, outside)


def bicubic(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Catmull-Rom interpolation, the edge repeated."""

    def weights(t: np.ndarray) -> list[np.ndarray]:
        return [((-t + 2) * t - 1) * t / 2, ((3 * t - 5) * t * t + 2) / 2, ((-3 * t + 4) * t + 1) * t / 2, (t - 1) * t * t / 2]

    h, w = a.shape
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    out = np.zeros(np.shape(x))
    for k, wy in enumerate(weights(y - i)):
        for m, wx in enumerate(weights(x - j)):
            out += wy * wx * a[np.clip(i + k - 1, 0, h - 1), np.clip(j + m - 1, 0, w - 1)]
    return out


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned and smoothing before shrinking."""
    for axis, n in ((0, height), (1, width)):
        if a.shape[axis] > n:
            a = convolve1d(a, gaussian_taps(0.5 * a.shape[axis] / n), "nearest", axis)
    y, x = (np.arange(height) + 0.5) * a.shape[0] / height - 0.5, (np.arange(width) + 0.5) * a.shape[1] / width - 0.5
    return bilinear(a, *np.meshgrid(x, y), outside=None)


def warp(a: np.ndarray, dy: np.ndarray, dx: np.ndarray, sign: float = 1.0) -> np.ndarray:
    """The image read at places moved by a field."""
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    return bilinear(a, x + sign * dx, y + sign * dy, outside=None)


def block_displacements(a: np.ndarray, b: np.ndarray, grid: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres (y, x) and shifts (y, x) of b against a on grid x grid blocks."""
    h, w = a.shape[0] // grid, a.shape[1] // grid
    p, d = [], []
    for i in range(grid):
        for j in range(grid):
            s = np.s_[i * h : (i + 1) * h, j * w : (j + 1) * w]
            p.append(((i + 0.5) * h, (j + 0.5) * w))
            d.append(phase_correlation(a[s], b[s], (limit, limit), sub=True))
    return np.array(p), np.array(d)


def dense_field(d: np.ndarray, grid: int, height: int, width: int, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """A field of every pixel from one of blocks."""
    return tuple(gaussian(resize(d[:, k].reshape(grid, grid), height, width), smooth) if smooth else resize(d[:, k].reshape(grid, grid), height, width) for k in (0, 1))


def centred_crop(a: np.ndarray, share: float) -> np.ndarray:
    my, mx = (int(round(n * share)) for n in a.shape)
    return a[my : a.shape[0] - my, mx : a.shape[1] - mx]


def overlap(a: np.ndarray, b: np.ndarray, dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
    """What a and the shifted b have in common: b[y + dy, x + dx] over a[y, x]."""
    h, w = a.shape
    ya, xa = max(0, -dy), max(0, -dx)
    n, m = h - abs(dy), w - abs(dx)
    return a[ya : ya + n, xa : xa + m], b[ya + dy : ya + dy + n, xa + dx : xa + dx + m]


def match_score(a: np.ndarray, b: np.ndarray, limit: tuple[int, int], least: float = 0.3) -> float:
    """Gradient correlation on the registered overlap; -1 if that is too small."""
    dy, dx = (int(s) for s in phase_correlation(a, b, limit))
    x, y = overlap(a, b, dy, dx)
    return gradient_correlation(x, y) if x.size >= least * a.size else -1.0


def best_orientation(a: np.ndarray, b: np.ndarray) -> tuple[int, bool, float]:
    """Of the eight turns and mirrors of b the one that correlates best with a, less a fine of a
    400th for each pixel of shift."""
    best = (0, False, -np.inf)
    for k in range(4):
        for mirror in (False, True):
            c = np.rot90(b[:, ::-1] if mirror else b, k)
            if c.shape != a.shape:
                continue
            r = np.fft.ifft2(np.fft.fft2(a - a.mean()) * np.fft.fft2(c - c.mean()).conj()).real / max(a.size * a.std() * c.std(), 1e-12)
            at = np.unravel_index(int(np.argmax(r)), r.shape)
            shift = np.hypot(*((p + n // 2) % n - n // 2 for p, n in zip(at, r.shape, strict=True)))
            if r[at] - shift / 400 > best[2]:
                best = (k, mirror, float(r[at] - shift / 400))
    return best


# ---- masks


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """By four neighbours, ``radius`` times."""
    for _ in range(radius):
        m = np.pad(mask, 1)
        mask = m[1:-1, 1:-1] | m[:-2, 1:-1] | m[2:, 1:-1] | m[1:-1, :-2] | m[1:-1, 2:]
    return mask


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    return ~dilate(~mask, radius)


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels 1 .. n of 4-connected components, in reading order: runs of each row joined."""
    h, w = mask.shape
    parent = [0]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    labels = np.zeros((h, w), np.int64)
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        for lo, hi in zip(edge[::2], edge[1::2], strict=True):
            up = np.unique(labels[y - 1, lo:hi]) if y else np.zeros(0, int)
            roots = {find(int(u)) for u in up if u}
            if not roots:
                parent.append(len(parent))
                root = len(parent) - 1
            else:
                root = min(roots)
                for r in roots:
                    parent[r] = root
            labels[y, lo:hi] = root
    root = np.array([find(k) for k in range(len(parent))])
    flat = root[labels]
    kept = np.unique(flat[flat > 0])
    order = np.zeros(len(parent), np.int64)
    order[kept] = np.arange(1, len(kept) + 1)
    return order[flat], len(kept)


def keep_large(mask: np.ndarray, least: int) -> np.ndarray:
    """Without components of fewer than ``least`` pixels, closed by 3 x 3."""
    lab, n = components(mask)
    size = np.bincount(lab.ravel(), minlength=n + 1)
    big = (size >= least)[lab] & mask
    pad = np.pad(big, 1)
    grown = np.lib.stride_tricks.sliding_window_view(pad, (3, 3)).any(axis=(2, 3))
    return np.lib.stride_tricks.sliding_window_view(np.pad(grown, 1, constant_values=True), (3, 3)).all(axis=(2, 3))


def centre_of_hole(labels: np.ndarray, reach: float = 0.3) -> tuple[float, float]:
    """The centroid (x, y) of the largest component of class 0 whose centroid lies within ``reach``
    of the middle; else that of the classes above 0; else the middle."""
    h, w = labels.shape
    lab, n = components(labels == 0)
    size = np.bincount(lab.ravel(), minlength=n + 1)
    y, x = np.mgrid[:h, :w]
    for k in np.argsort(-size[1:], kind="stable") + 1 if n else []:
        m = lab == k
        cy, cx = y[m].mean(), x[m].mean()
        if abs(cy - (h - 1) / 2) <= reach * h and abs(cx - (w - 1) / 2) <= reach * w:
            return float(cx), float(cy)
    film = labels > 0
    return (float(x[film].mean()), float(y[film].mean())) if film.any() else ((w - 1) / 2, (h - 1) / 2)


def components_by_radius(mask: np.ndarray, cx: float, cy: float, least: int, shrink: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Components of at least ``least`` pixels numbered by mean radius (from 0; -1: none), and those radii."""
    lab, n = components(erode(mask, shrink) if shrink else mask)
    y, x = np.mgrid[: mask.shape[0], : mask.shape[1]]
    size = np.bincount(lab.ravel(), minlength=n + 1)
    r = np.bincount(lab.ravel(), np.hypot(x - cx, y - cy).ravel(), n + 1) / np.maximum(size, 1)
    kept = np.flatnonzero(size[1:] >= least) + 1
    kept = kept[np.argsort(r[kept], kind="stable")]
    number = np.full(n + 1, -1, np.int64)
    number[kept] = np.arange(len(kept))
    return number[lab], r[kept]


def geodesic(mask: np.ndarray, source: tuple[int, int]) -> np.ndarray:
    """Distances inside a mask from a pixel over eight neighbours; infinite where none leads."""
    h, w = mask.shape
    out = np.full((h, w), np.inf)
    out[source] = 0.0
    heap = [(0.0, *source)]
    near = [(dy, dx, float(np.hypot(dy, dx))) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    while heap:
        d, y, x = heapq.heappop(heap)
        if d > out[y, x]:
            continue
        for dy, dx, c in near:
            i, j = y + dy, x + dx
            if 0 <= i < h and 0 <= j < w and mask[i, j] and d + c < out[i, j]:
                out[i, j] = d + c
                heapq.heappush(heap, (d + c, i, j))
    return out


def marks(frame: np.ndarray, threshold: float, area: int, heights: tuple[int, int], widths: tuple[int, int]) -> dict[str, tuple[float, float]]:
    """Centres (x, y) of bright components of the right size, one for each corner: the last met."""
    lab, n = components(frame > threshold)
    h, w = frame.shape
    out: dict[str, tuple[float, float]] = {}
    for k in range(1, n + 1):
        y, x = np.nonzero(lab == k)
        if len(y) >= area and heights[0] <= np.ptp(y) + 1 <= heights[1] and widths[0] <= np.ptp(x) + 1 <= widths[1]:
            corner = ("t" if y.mean() < h / 2 else "b") + ("l" if x.mean() < w / 2 else "r")
            out[corner] = (float(x.mean()), float(y.mean()))
    return out


def box_match(a: np.ndarray, hz: int, hc: int, surround: int) -> np.ndarray:
    """Mean of a box less the mean of the frame around it, by prefix sums."""

    def box(r: int, c: int) -> tuple[np.ndarray, int]:
        p = np.pad(a, ((r, r), (c, c)), "edge")
        s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        n, m = 2 * r + 1, 2 * c + 1
        return s[n:, m:] - s[:-n, m:] - s[n:, :-m] + s[:-n, :-m], n * m

    inner, ni = box(hz, hc)
    outer, no = box(hz + surround, hc + surround)
    return inner / ni - (outer - inner) / (no - ni)


def coarse_noise(height: int, width: int, cell: int, seed: int) -> np.ndarray:
    """Smooth noise of mean 0 and deviation 1 from a coarse seeded grid."""
    rng = np.random.default_rng(seed)
    g = resize(rng.normal(size=(max(2, height // cell + 1), max(2, width // cell + 1))), height, width)
    return (g - g.mean()) / max(g.std(), 1e-12)
