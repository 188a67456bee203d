"""Simple-8b: unsigned integers packed into 64-bit words, and a file format of such words.

A word's top four bits are its selector: how many values of how many bits fill the other sixty.
Selector 15 is an escape: the next word is one value of 64 bits. Values are coded in blocks, each
of which starts a new word; the offsets of the blocks let a reader decode any of them alone.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: selector -> (values in a word, bits of each).
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
ESCAPE, BLOCK, MAGIC = 15, 4096, b"LAM-S8B1"
_COUNT = np.array([0, *(n for n, _ in SELECTORS.values()), 1], np.int64)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, at least 1."""
    out = np.frexp(values.astype(np.float64))[1]
    near = values >= 2**53  # there a float can round up to the next power of two
    if near.any():
        out[near] = [int(v).bit_length() for v in values[near]]
    return np.maximum(out, 1).astype(np.uint8)


def _ahead(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` moved n places to the front, its end filled with the largest byte."""
    out = np.full_like(a, 255)
    out[: max(0, len(a) - n)] = a[n:]
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``values`` and, for each block of BLOCK values, the word it starts at."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = values.astype(np.uint64, copy=False)
    left = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n)).astype(np.int32)
    most = {1: _widths(values)}  # of the next k values, the most bits
    for k, (a, b) in {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (3, 2), 6: (3, 3), 7: (4, 3), 8: (4, 4), 10: (5, 5), 12: (6, 6), 15: (8, 7), 20: (10, 10), 30: (15, 15), 60: (30, 30)}.items():
        most[k] = np.maximum(most[a], _ahead(most[b], a))
    choice = np.full(n, ESCAPE, np.uint8)
    for s, (k, width) in reversed(SELECTORS.items()):
        choice[(most[k] <= width) & (left >= k)] = s
    starts = np.arange(0, n, BLOCK)
    ends, at, open_ = np.minimum(starts + BLOCK, n), starts.copy(), np.arange(len(starts))
    visited = []
    while len(open_):
        p = at[open_]
        visited.append((open_, p))
        at[open_] = p + _COUNT[choice[p]]
        open_ = open_[at[open_] < ends[open_]]
    first = np.sort(np.concatenate([p for _, p in visited]))
    chosen = choice[first]
    size = np.where(chosen == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s, (k, width) in SELECTORS.items():
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            w = np.full(len(mine), s << 60, np.uint64)
            for j in range(k):
                w |= values[first[mine] + j] << np.uint64(width * j)
            words[place[mine]] = w
    escaped = np.flatnonzero(chosen == ESCAPE)
    words[place[escaped]] = np.uint64(ESCAPE << 60)
    words[place[escaped] + 1] = values[first[escaped]]
    return words, place[np.searchsorted(first, starts)]


def decode(words: np.ndarray) -> np.ndarray:
    """The values of whole blocks' words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    count = np.where(raw, 0, _COUNT[selector])
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s, (k, width) in SELECTORS.items():
        mine = np.flatnonzero((selector == s) & ~raw)
        if len(mine):
            mask = np.uint64((1 << width) - 1)
            for j in range(k):
                out[place[mine] + j] = (words[mine] >> np.uint64(width * j)) & mask
    escapes = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[place[escapes]] = words[escapes + 1]
    return out


class Writer:
    """Writes a file: MAGIC, words, then document ids, their counts of values, the blocks' word
    offsets, and four numbers: how many words, documents, blocks and values there are."""

    def __init__(self, sink):
        self.sink, self.held = sink, np.zeros(0, np.uint64)
        self.docs, self.counts, self.offsets, self.words, self.values = [], [], [], 0, 0
        sink.write(MAGIC)

    def add(self, docs: np.ndarray, counts: np.ndarray, values: np.ndarray) -> None:
        self.docs.append(docs.astype(np.int64))
        self.counts.append(counts.astype(np.int64))
        self.values += len(values)
        values = np.concatenate([self.held, values.astype(np.uint64)])
        whole = len(values) // BLOCK * BLOCK
        self._put(values[:whole])
        self.held = values[whole:]

    def _put(self, values: np.ndarray) -> None:
        words, offsets = encode(values)
        self.sink.write(words.astype("<u8").tobytes())
        self.offsets.append(offsets + self.words)
        self.words += len(words)

    def close(self) -> None:
        self._put(self.held)
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype("<i8")
        docs, counts, offsets = join(self.docs), join(self.counts), join(self.offsets)
        for a in (docs, counts, offsets, np.array([self.words, len(docs), len(offsets), self.values], "<i8")):
            self.sink.write(a.tobytes())


class Reader:
    """Reads such a file through a random-access file object with read_at(size, offset)."""

    def __init__(self, source, size: int):
        self.source = source
        if source.read_at(8, 0) != MAGIC:
            raise ValueError("not a file of Simple-8b words")
        self.words, docs, blocks, self.values = np.frombuffer(source.read_at(32, size - 32), "<i8").tolist()
        at = 8 + 8 * self.words
        part = lambda n, at: np.frombuffer(source.read_at(8 * n, at), "<i8")
        self.docs, self.counts, self.offsets = part(docs, at), part(docs, at + 8 * docs), part(blocks, at + 16 * docs)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The values of blocks first to last - 1."""
        lo = int(self.offsets[first])
        hi = int(self.offsets[last]) if last < len(self.offsets) else self.words
        return decode(np.frombuffer(self.source.read_at(8 * (hi - lo), 8 + 8 * lo), "<u8"))

    def runs(self, blocks: int = 256):
        """All values, some blocks at a time."""
        for i in range(0, len(self.offsets), blocks):
            yield self.blocks(i, min(i + blocks, len(self.offsets)))
