"""Words and word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from lamina.llm.common import WordHashes, mix64

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, in order; with fewer words, one for the whole
    sequence; without words, none."""
    n = len(words)
    size = min(size, n)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = mix64(h * _ODD + words[k : n - size + 1 + k])
    return h


def shingle_set(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text, sorted. Words are runs of other characters than
    [\\x20\\x09-\\x0D], A-Z lower-cased."""
    return np.unique(shingle_hashes(hashes.of(text.lower().split()), size))
