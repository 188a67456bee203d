"""Benchmark decontamination: SimHash fingerprints of item-sized windows of documents.

Every item has a 64-bit SimHash of its weighted shingles. A document's windows of the item's
length are fingerprinted alike; a document shorter than the item is one window as a whole. A window
without enough weight in benchmark shingles, or a whole document too light for the items, cannot be
similar to any item, so those alone are passed over. Fingerprints are looked up in a multi-index:
eight blocks of eight bits, each asked for every key at most FLIPS bits away. Two fingerprints at
most RADIUS apart agree to within FLIPS bits in some block, so none within the radius is missed.
Exact weighted similarity of the shingle multisets then verifies what the index proposes.

At similarity 0.8 windows' fingerprints are 9.7 bits apart on average, with a deviation of 2.9; a
test counts windows that are similar but beyond the radius.

The items' index is broadcast; INDEX_BYTES bounds it (or one item, if that is larger). More items
take several passes over the documents, one after another, each with its part of the index alone.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import WordHashes, in_worker, mix64, portions, save, small_batches

RADIUS, BLOCKS, FLIPS, SCREEN_BITS = 22, 8, 2, 22
#: Bytes of the index of one pass over the documents, besides its screens of 2**SCREEN_BITS bytes
#: for each shingle size; bytes of text taken at once.
INDEX_BYTES, TEXT_BYTES = 64 << 20, 4 << 20
#: What an item costs in the index: itself, and each byte of its text (a word and the space behind
#: it have two at least; a shingle takes 8 bytes of hash twice and 4 of weight).
_ITEM_COST, _BYTE_COST = 128, 10
_MARKS = string.punctuation.encode()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEAR = np.array([k for k in range(256) if k.bit_count() <= FLIPS], np.uint8)


class _Words(WordHashes):
    """Hashes of words without the marks around them; 0 for a word of marks alone."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        bare = word.strip(_MARKS)
        # the low byte carries the length, for the weight
        h = self[word] = (xxhash.xxh3_64_intdigest(bare) & ~255 | min(len(bare), 255)) if bare else 0
        return h


def words_of(text: bytes, hashes: _Words) -> np.ndarray:
    w = hashes.of(text.lower().split())
    return w[w != 0]


def shingles_of(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights (bytes in their words) of a sequence's shingles, in order."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, weight = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(size):
        part = words[k : k + n]
        h = h * _BASE + part
        weight += (part & np.uint64(255)).astype(np.int64)
    return mix64(h), weight


def _signs(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(mix64(h + np.uint64(99)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int64) * 2 - 1


def _pack(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1).view(np.uint64).ravel()


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    keys, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    left = np.bincount(where[: len(a)], wa, len(keys))
    right = np.bincount(where[len(a) :], wb, len(keys))
    return float(np.minimum(left, right).sum() / np.maximum(left, right).sum())


class _Group:
    """Items of one length: their fingerprints in a multi-index, once in each block."""

    def __init__(self, length: int, size: int, items: list[tuple[int, np.ndarray, np.ndarray]]):
        self.length, self.size, self.items = length, size, items
        self.least = min(int(w.sum()) for _, _, w in items)
        self.prints = np.concatenate([_pack((_signs(h) * w[:, None]).sum(axis=0)[None]) for _, h, w in items])
        self.lists = []
        for key in self.prints.view(np.uint8).reshape(-1, BLOCKS).T:
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.lists.append((np.searchsorted(key[order], np.arange(257)).astype(np.int32), order))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(print, item) pairs at most RADIUS bits apart."""
        keys = prints.view(np.uint8).reshape(-1, BLOCKS)
        found = []
        for k, (bounds, items) in enumerate(self.lists):
            near = (keys[:, k, None] ^ _NEAR[None]).ravel().astype(np.int64)
            lo, n = bounds[near].astype(np.int64), (bounds[near + 1] - bounds[near]).astype(np.int64)
            which = np.repeat(np.arange(len(near)) // len(_NEAR), n)
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found.append(which * len(self.prints) + items[at])
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(self.prints), pair % len(self.prints)
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], item[close]


class Index:
    """The items of one pass."""

    def __init__(self, items: list[tuple[int, bytes]], shingle_words: int):
        hashes, groups, screens = _Words(), {}, {}
        for item, text in items:
            words = words_of(text, hashes)
            size = min(shingle_words, len(words))
            if size:
                h, w = shingles_of(words, size)
                w = w.astype(np.int32)
                groups.setdefault((len(words), size), []).append((item, h, w))
                screens.setdefault(size, []).append(h)
        self.groups = [_Group(length, size, rows) for (length, size), rows in sorted(groups.items())]
        self.known = {size: np.unique(np.concatenate(h)) for size, h in screens.items()}
        self.screen = {}
        for size, known in self.known.items():
            table = np.zeros(1 << SCREEN_BITS, bool)
            table[(known >> np.uint64(64 - SCREEN_BITS)).astype(np.int64)] = True
            self.screen[size] = table

    def matches(self, words: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
        """(item, first word, word after the last, similarity) of a document's windows."""
        out = []
        for size, known in self.known.items():
            h, weight = shingles_of(words, size)
            maybe = np.flatnonzero(self.screen[size][(h >> np.uint64(64 - SCREEN_BITS)).astype(np.int64)])
            if not len(maybe):
                continue
            at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
            hits = maybe[known[at] == h[maybe]]
            if len(hits):
                out += self._near(size, h, weight, hits, threshold)
        return out

    def _near(self, size, h, weight, hits, threshold) -> list[tuple[int, int, int, float]]:
        hit = np.zeros(len(h), np.int64)
        hit[hits] = weight[hits]
        upto = np.concatenate([[0], np.cumsum(weight)])
        hit_upto = np.concatenate([[0], np.cumsum(hit)])
        found = []
        for g in (g for g in self.groups if g.size == size):
            m = g.length - size + 1
            if m > len(h):  # the whole document is the one window
                m = len(h)
                if upto[-1] < threshold * g.least - 1e-9:  # too light to be similar to any
                    continue
            inside, total = hit_upto[m:] - hit_upto[:-m], upto[m:] - upto[:-m]
            starts = np.flatnonzero(inside >= threshold * total - 1e-9)
            for lo in range(0, len(starts), 512):
                some = starts[lo : lo + 512]
                votes = self._votes(h, weight, some, m)
                for w, i in zip(*g.candidates(_pack(votes)), strict=True):
                    p = int(some[w])
                    item, ih, iw = g.items[i]
                    s = similarity(h[p : p + m], weight[p : p + m], ih, iw)
                    if s >= threshold - 1e-12:
                        found.append((item, p, p + m + size - 1, s))
        return _best(found)

    @staticmethod
    def _votes(h, weight, starts, m) -> np.ndarray:
        """Sums of signed weights over windows; windows side by side share a running sum."""
        out = np.empty((len(starts), 64), np.int64)
        cut = np.flatnonzero(np.diff(starts) > m) + 1
        for lo, hi in zip([0, *cut], [*cut, len(starts)], strict=True):
            first, last = int(starts[lo]), int(starts[hi - 1]) + m
            sums = np.zeros((last - first + 1, 64), np.int64)
            np.cumsum(_signs(h[first:last]) * weight[first:last, None], axis=0, out=sums[1:])
            at = starts[lo:hi] - first
            out[lo:hi] = sums[at + m] - sums[at]
        return out


def _best(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of an item's overlapping windows, the most similar one (ties: the first)."""
    out: list[tuple[int, int, int, float]] = []
    taken: dict[int, list[tuple[int, int]]] = {}
    for item, lo, hi, s in sorted(found, key=lambda x: (-x[3], x[1])):
        if all(hi <= a or b <= lo for a, b in taken.get(item, ())):
            taken.setdefault(item, []).append((lo, hi))
            out.append((item, lo, hi, s))
    return sorted(out)


def _passes(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, shingle_words: int) -> tuple[int, Iterator]:
    """How many passes the items take, and each one's broadcast index, made when it is asked for."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    total = items.agg(F.sum(_ITEM_COST + _BYTE_COST * F.octet_length("text").cast("long"))).first()[0] or 0
    passes = -(-total // INDEX_BYTES) or 1

    def each():
        for k in range(passes):
            mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)  # a bounded part
            yield spark.sparkContext.broadcast(Index([(r[0], bytes(r[1])) for r in mine.collect()], shingle_words))

    return passes, each()


def _texts(batches: Iterator[pa.RecordBatch], text: str):
    words = in_worker("decontamination words", _Words)
    for b in portions(batches, text, TEXT_BYTES):
        yield b, (words_of(t or b"", words) for t in b[text].cast(pa.binary()).to_pylist())


def find_leaks(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each place where a document repeats a benchmark item: doc_id, item_id,
    first_word and last_word (positions among the document's words, the last exclusive) and
    similarity.

    Words are split at [\\x20\\x09-\\x0D], A-Z lower-cased, punctuation of ASCII around them
    removed; words of punctuation alone don't count. A window has as many words as the item; a
    document with fewer words is one window as a whole. Its similarity is the weighted Jaccard
    similarity of the multisets of shingles, a shingle weighing the bytes of its words (a word 255
    at most). Items with fewer words than ``shingle_words`` are one shingle. Of overlapping windows
    for one item the most similar counts, ties to the first.

    Null or empty texts and items match nothing. Null ids stay null in the rows. Repeated rows
    repeat theirs. Empty tables give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def search(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, texts in _texts(batches, "text"):
                found = [(i, *m) for i, words in zip(b["doc_id"].to_pylist(), texts, strict=True) for m in index.value.matches(words, threshold)]
                if found:
                    yield pa.record_batch(dict(zip(("doc_id", "item_id", "first_word", "last_word", "similarity"), map(list, zip(*found, strict=True)), strict=True)), schema=schema)

        return run

    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("similarity", pa.float64())])
    kind = "doc_id long, item_id long, first_word int, last_word int, similarity double"
    passes, indexes = _passes(docs, benchmark, item_col, item_text_col, shingle_words)
    out = None
    for index in indexes:
        part = rows.mapInArrow(search(index), kind)
        if passes > 1:
            part = save(part, "leaks")
            index.destroy()
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, threshold: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that repeat no benchmark item, as find_leaks() tells, with all their
    columns; nothing is shuffled. Rows with a null or empty text stay. Each further pass over the
    items reads and writes the rows that are left."""

    def keep(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, texts in _texts(batches, text_col):
                yield b.filter(pa.array([not index.value.matches(words, threshold) for words in texts], pa.bool_()))

        return run

    passes, indexes = _passes(docs, benchmark, item_col, item_text_col, shingle_words)
    for index in indexes:
        docs = docs.mapInArrow(keep(index), docs.schema)
        if passes > 1:
            docs = save(docs, "decontaminated")
            index.destroy()
    return docs
