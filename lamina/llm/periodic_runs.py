"""Periodic runs of words: stretches that repeat themselves two times or more, one after another.

Every lag up to half the number of words is scanned: the array of word ids is compared with itself
shifted by the lag, many lags at a time, and stretches of equal words become runs. A stretch of k
equal words at lag q is a run of k + q words with period q. If its smallest period is less, that
divides q, and the very same stretch is found at the smaller lag too; so of runs with equal start
and length the smallest lag is the period, and results of different lag ranges merge by a minimum.
Short texts are scanned where they lie; a longer one is dealt out over the cluster as ranges of
LAGS lags.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import free, portions, shuffle_partitions, small_batches, with_columns

#: Texts of more bytes are dealt out by ranges of lags.
LONG_BYTES = 32_768
#: Lags of a range: a range costs LAGS comparisons for each word, and one copy of the word ids.
LAGS = 4096
#: Cells compared at once.
CELLS = 1 << 19
RUNS = "array<struct<start:long,length:long,period:long>>"


def words_of(text: str) -> list[bytes]:
    """Maximal stretches without [\\x20\\x09-\\x0D]: what bytes.split() cuts at."""
    return text.encode("utf-8", "surrogatepass").split()


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers, from 0."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
    return ids.astype(np.int16) if len(seen) < 1 << 15 else ids


def _together(flags: np.ndarray, k: int) -> np.ndarray:
    """Where k flags in a row start, with shifts that double."""
    have = 1
    while have < k and len(flags):
        step = min(have, k - have)
        flags = flags[:-step] & flags[step:]
        have += step
    return flags


def scan(ids: np.ndarray, lo: int, hi: int, min_length: int, min_exponent: int) -> dict[tuple[int, int], int]:
    """{(start, length): smallest lag in lo..hi-1 at which that is a run}."""
    n, found = len(ids), {}
    hi = min(hi, n // min_exponent + 1)
    if lo >= hi:
        return found
    padded = np.concatenate([ids, np.full(hi, -1, ids.dtype)])
    rows = max(1, CELLS // n)
    for a in range(lo, hi, rows):
        b = min(hi, a + rows)
        width = n - a + 1  # the last cell of each row meets the padding: stretches end there
        shifted = np.lib.stride_tricks.sliding_window_view(padded[a : b - 1 + width], width)
        equal = shifted == ids[:width]
        lags = np.arange(a, b)
        need = np.maximum(min_length - lags, (min_exponent - 1) * lags)
        some = np.flatnonzero(_together(equal.ravel(), int(need.min())))
        for r in np.unique(some // width):
            edges = np.flatnonzero(np.diff(equal[r].view(np.int8), prepend=0))
            starts, ends = edges[::2], edges[1::2]
            q = a + int(r)
            long = ends - starts >= need[r]
            for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                found.setdefault((s, e - s + q), q)
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run contains after its first period, joined by one space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _ranges(min_exponent: int):
    """(key, lo, hi, ids) for each range of lags of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text", 1):
            for key, text in zip(b["key"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = word_ids(words_of(text)).astype("<i4")
                for lo in range(1, len(ids) // min_exponent + 1, LAGS):
                    yield pa.record_batch({"key": pa.array([key], pa.string()), "lo": [lo], "hi": [lo + LAGS], "ids": [ids.tobytes()]})

    return run


def _scan_ranges(min_length: int, min_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, lo, hi, ids in zip(*(b[c].to_pylist() for c in ("key", "lo", "hi", "ids")), strict=True):
                runs = scan(np.frombuffer(ids, "<i4"), lo, hi, min_length, min_exponent)
                if runs:
                    start, length = np.array(list(runs), np.int64).T
                    yield pa.record_batch({"key": pa.array([key] * len(runs), pa.string()), "start": start, "length": length, "period": np.array(list(runs.values()), np.int64)})

    return run


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = 12, min_exponent: int = 2) -> DataFrame:
    """``docs`` with columns n_words (long), runs (array of start, length and period, by start,
    then period) and collapsed (the text without the words that repeat a run's first period).

    A run is a stretch of words with smallest period q (words q apart are equal) that holds
    min_exponent periods and min_length words at least and that no neighbouring word extends; words
    are numbered from 0 and compared by their bytes. Runs may overlap and nest. Null or empty text,
    or one without words: 0, no runs, empty. Repeated rows get equal results; of long texts that are
    equal one is scanned. Texts of any length are scanned whole; a text has fewer runs than words.
    Empty table: no rows. Other columns pass through; a new column whose name is taken gets an
    underscore.
    """
    if min_exponent < 2:
        raise ValueError("runs need two periods at least")
    spark = docs.sparkSession
    small_batches(spark)
    key, text, found = (free(docs, f"__runs_{x}") for x in ("key", "text", "found"))
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    size = F.octet_length(F.col(text))
    fields = {"n_words": "long", "runs": RUNS, "collapsed": "string"}

    def whole(texts: list[str]):
        out = []
        for t in texts:
            words = words_of(t)
            runs = scan(word_ids(words), 1, len(words), min_length, min_exponent)
            out.append(_described(words, [(s, n, q) for (s, n), q in runs.items()]))
        return list(zip(*out, strict=True)) or [[]] * 3

    short = with_columns(rows.where(size <= LONG_BYTES), fields, whole, text)
    # an equal text has an equal key, and equal runs
    long = rows.where(size > LONG_BYTES).withColumn(key, F.sha2(F.col(text), 256))
    texts = long.groupBy(F.col(key).alias("key")).agg(F.first(text).alias("text"))
    ranges = texts.mapInArrow(_ranges(min_exponent), "key string, lo long, hi long, ids binary").repartition(shuffle_partitions(spark), "key", "lo")
    parts = ranges.mapInArrow(_scan_ranges(min_length, min_exponent), "key string, start long, length long, period long")
    runs = parts.groupBy("key", "start", "length").agg(F.min("period").alias("period")).groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    # runs travel beside the text in one string: numbers, a line feed, the text
    numbers = F.concat_ws(" ", F.flatten(F.transform("runs", lambda r: F.array(r["start"], r["length"], r["period"]))))
    joined = long.join(runs.select(F.col("key").alias(key), numbers.alias(found)), key, "left")
    joined = joined.withColumn(text, F.concat(F.coalesce(F.col(found), F.lit("")), F.lit("\n"), F.col(text)))

    def given(texts: list[str]):
        out = []
        for numbers, _, t in (x.partition("\n") for x in texts):
            flat = list(map(int, numbers.split()))
            out.append(_described(words_of(t), list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))))
        return list(zip(*out, strict=True)) or [[]] * 3

    done = with_columns(joined.drop(key, found), fields, given, text)
    return short.union(done).drop(text)


def _described(words: list[bytes], runs: list[tuple[int, int, int]]):
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    return len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapsed(words, runs)
