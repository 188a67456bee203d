"""What the operators share: the scratch folder, cut points in a plan, and name clashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import time
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters that count as white space, as in [\x20\x09-\x0D].
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
BATCH_BYTES = 8 << 20
#: Seconds between two calls for the driver's garbage, so that shuffle files which nothing needs go.
TIDY_SECONDS = 5.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_written: list[tuple[SparkSession, str]] = []
_tidied = 0.0


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a
    local session gets a temporary folder; on a cluster executors could not read it, so there it is
    an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share ({master})")
        at = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI; without a scheme it lies on the cluster's default file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^file:/+", "file:///", uri)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder that nothing else uses; it goes when the driver ends."""
    path = f"{scratch(spark)}/lamina/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the scratch folder and read it again. This cuts lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    del df
    tidy(spark)
    return out


def park(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept on the executors' disks until drop(). What a lost executor
    held is computed again, from the saved tables that ``df`` comes from."""
    return df.persist(StorageLevel.DISK_ONLY)


def drop(*parked: DataFrame) -> None:
    for df in parked:
        df.unpersist()
    if parked:
        tidy(parked[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Let shuffle files go that nothing needs any more: they stay until the driver collects its
    garbage. At most once in TIDY_SECONDS."""
    global _tidied
    if time.monotonic() - _tidied >= TIDY_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _tidied = time.monotonic()


def forget(*saved: DataFrame) -> None:
    """Delete tables made by save() that nothing will read again."""
    for df in saved:
        remove(df.sparkSession, df._lamina_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended
            return


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def free(df: DataFrame, name: str) -> str:
    """``name``, or with underscores appended if ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bits(n: int) -> int:
    return max(0, int(n - 1)).bit_length()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def in_worker(key, make):
    """``make()``, or what it returned for the same key earlier in this process; one such thing is
    kept at a time. Functions arrive pickled by value, with globals of their own, so it lives
    among the loaded modules."""
    kept = sys.modules.setdefault("_lamina_worker", types.ModuleType("_lamina_worker")).__dict__
    if kept.get("key") != key:
        kept["value"] = None
        kept.update(key=key, value=make())
    return kept["value"]


def release() -> None:
    """Give memory that a task no longer uses back to the system: idle workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Hold batches for Python to BATCH_BYTES, unless the session has a bound of its own: the
    default is 64 MB for each task, on either side, and texts can be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "64MB", "67108864b", "67108864"):
        spark.conf.set(name, BATCH_BYTES)


class WordHashes(dict):
    """64-bit hashes of words (bytes); remembers the words it has met, up to ``limit``."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def portions(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each, one row at least."""
    try:
        for b in batches:
            size = np.cumsum(np.nan_to_num(pyarrow.compute.binary_length(b[text]).to_numpy(zero_copy_only=False)))
            lo = 0
            while lo < len(b):
                base = size[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(size, base + most, side="right")))
                yield b.slice(lo, hi - lo)
                lo = hi
    finally:
        release()


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_columns(df: DataFrame, fields: dict[str, str], make, text: str) -> DataFrame:
    """``df`` with one new column for each entry of ``fields`` (name: type), which
    ``make(texts)`` computes from the texts (strings; null ones are empty) of a portion of rows as one
    list or array for each field. Other columns pass through; a taken name gets an underscore."""
    small_batches(df.sparkSession)
    names = {f: free(df, f) for f in fields}
    plain = df.sparkSession.createDataFrame([], ", ".join(f"`{names[f]}` {t}" for f, t in fields.items())).schema
    types = to_arrow_schema(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, text, BATCH_BYTES // 4):
            columns = make([t or "" for t in b[text].to_pylist()])
            made = [pa.array(c, f.type) for c, f in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *types.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *plain.fields]))
