"""Gradient-boosted trees for a binary label, on binned features, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        self.feature.append(-1)
        self.cut.append(0.0)
        self.left.append(0)
        self.value.append(value)
        return len(self.value) - 1

    def freeze(self) -> None:
        self.arrays = tuple(np.array(x) for x in (self.feature, self.cut, self.left, self.value))

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, value = self.arrays
        at = np.zeros(len(x), np.int64)
        while True:
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return value[at]
            node = at[inner]
            at[inner] = left[node] + (x[inner, f[inner]] > cut[node])


class BoostedTrees:
    """Logistic loss, second-order leaf values, splits at quantile bins."""

    def __init__(self, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 2.0, least: float = 3.0):
        self.n, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, k = x.shape
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)  # bin b: cuts[b-1] < v <= cuts[b]
        width = self.bins + 1
        flat = binned + np.arange(k) * width
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        f = np.full(n, self.base)
        for _ in range(self.n):
            p = _sigmoid(f)
            g, h = y - p, p * (1 - p)
            tree, rows = Tree(), {0: np.arange(n)}
            tree.add(float(g.sum() / (h.sum() + self.ridge)))
            for _ in range(self.depth):
                grown = {}
                for node, mine in rows.items():
                    split = self._split(flat[mine], g[mine], h[mine], k, width)
                    if split is None:
                        continue
                    j, b = split
                    if b >= len(cuts[j]):
                        continue
                    right = binned[mine, j] > b
                    tree.feature[node], tree.cut[node] = j, float(cuts[j][b])
                    tree.left[node] = len(tree.value)
                    for part in (mine[~right], mine[right]):
                        grown[tree.add(float(g[part].sum() / (h[part].sum() + self.ridge)))] = part
                rows = grown
            tree.freeze()
            self.trees.append(tree)
            f += self.rate * tree.predict(x)
        return self

    def _split(self, flat, g, h, k, width):
        if len(flat) < 2 * self.least:
            return None
        at = flat.ravel()
        gs, hs, ns = (np.bincount(at, np.repeat(w, k), k * width).reshape(k, width).cumsum(axis=1) for w in (g, h, np.ones(len(g))))
        gt, ht, nt = gs[0, -1], hs[0, -1], ns[0, -1]
        gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
        gain[(ns < self.least) | (nt - ns < self.least)] = -1
        best = int(np.argmax(gain))
        return divmod(best, width) if gain.ravel()[best] > 1e-6 else None

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for t in self.trees:
            f += self.rate * t.predict(x)
        return f


class Isotonic:
    """A rising piecewise linear map of margins to probabilities, through the centres of the
    blocks that pooling adjacent violators leaves. A thousandth of the plain probability keeps
    the order within a block."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # mean label, weight, mean margin
        for m, label in zip(margin[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([label, 1.0, m])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                b, a = blocks.pop(), blocks.pop()
                w = a[1] + b[1]
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, (a[2] * a[1] + b[2] * b[1]) / w])
        self.at = np.array([b[2] for b in blocks])
        self.to = np.array([b[0] for b in blocks])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(0.999 * np.interp(margin, self.at, self.to) + 0.001 * _sigmoid(margin), 0.0, 1.0)


class Calibrated:
    """Trees fitted to all rows; their calibration from margins of trees that did not see the row."""

    def __init__(self, x: np.ndarray, y: np.ndarray, folds: int = 4):
        self.constant = float(y.mean()) if len(y) else 0.0
        self.trees = None
        if len(y) and 0 < y.sum() < len(y):
            self.trees = BoostedTrees().fit(x, y)
            unseen, fold = np.zeros(len(y)), np.arange(len(y)) % folds
            for k in range(folds):
                out = fold == k
                if out.any() and 0 < y[~out].sum() < (~out).sum():
                    unseen[out] = BoostedTrees().fit(x[~out], y[~out]).margin(x[out])
                else:
                    unseen[out] = self.trees.margin(x[out])
            self.map = Isotonic(unseen, y)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.trees is None else self.map(self.trees.margin(x))
