"""A minimal perfect hash over 64-bit keys, with arrays that it indexes."""

from __future__ import annotations

import numpy as np

from lamina.llm.common import mix64

LEVELS, LOAD = 40, 2


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Each key's slot on a level of ``size`` slots."""
    h = mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


class PerfectHash:
    """Each level keeps the keys that alone reach their slot, as one set bit; the rest go on to
    the next level. A key's index is the rank of its bit. Keys that no level could part
    (equal ones) follow in a sorted tail."""

    def __init__(self, keys: np.ndarray | None = None):
        self.sizes: list[int] = []
        bitmaps, left = [], np.zeros(0, np.uint64) if keys is None else keys.astype(np.uint64)
        while len(left) and len(self.sizes) < LEVELS:
            size = -(-LOAD * len(left) // 64) * 64
            at = _slots(left, len(self.sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.sizes.append(size)
            bitmaps.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at.astype(np.int64)]]
        self.bitmap = np.concatenate(bitmaps) if bitmaps else np.zeros(0, np.uint8)
        self.tail = np.sort(left)
        self._rank()

    def _rank(self) -> None:
        words = self.bitmap.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.before[-1]) + len(self.tail)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index; an arbitrary index or -1 for a key that is not in the set."""
        keys = keys.astype(np.uint64, copy=False)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        words = self.bitmap.view(np.uint64)
        for level, size in enumerate(self.sizes):
            if not len(todo):
                return out
            at = self.starts[level] + _slots(keys[todo], level, size).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[found]] = self.before[at >> 6][found] + below[found]
            todo = todo[~found]
        if len(todo) and len(self.tail):
            k = np.searchsorted(self.tail, keys[todo])
            hit = (k < len(self.tail)) & (self.tail[np.minimum(k, len(self.tail) - 1)] == keys[todo])
            out[todo[hit]] = int(self.before[-1]) + k[hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), len(self.tail), *self.sizes], np.int64)
        return head.tobytes() + self.tail.tobytes() + self.bitmap.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        levels, tail = np.frombuffer(data, np.int64, 2)
        self = cls.__new__(cls)
        self.sizes = np.frombuffer(data, np.int64, levels, 16).tolist()
        at = 16 + 8 * int(levels)
        self.tail = np.frombuffer(data, np.uint64, tail, at)
        self.bitmap = np.frombuffer(data, np.uint8, -1, at + 8 * int(tail))
        self._rank()
        return self
