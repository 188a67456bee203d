"""Sources: array files as tables, discovery of numbered files, and injected codecs.

``spark.read.format("array_files")`` (after register()) reads .npy files of any rank from 1 to 3 as
rows (path, z, row, px): one input partition for each file, read through pyarrow's file systems.
.npz archives are read alike; option ``key`` names their array (the first one, unless given).
Options z_from and z_to (exclusive) bound z: files whose names or headers place them outside are
not read. Other formats enter by ``CODECS``: a suffix and a function of bytes and key to an array.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

def _npz(data: bytes, key: str | None) -> np.ndarray:
    with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
        return arrays[key or arrays.files[0]]


CODECS: dict[str, Callable[[bytes, str | None], np.ndarray]] = {".npy": lambda data, key: np.load(io.BytesIO(data), allow_pickle=False), ".npz": _npz}
#: Bytes from which a .npy file's shape is told before the rest is read.
HEADER = 1 << 12
SCHEMA = "path string, z long, row long, px array<double>"


def _open(path: str):
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(path)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def first_z(path: str) -> int:
    """Where a file's z starts: the first of the two numbers of a range, or the last number."""
    name = path.rsplit("/", 1)[-1]
    if m := re.search(r"(\d+)-(\d+)\D*$", name):
        return int(m.group(1))
    return int(m.group(1)) if (m := re.search(r"(\d+)(?!.*\d)", name)) else 0


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.z_from, self.z_to = options["path"], int(options.get("z_from", 0)), int(options.get("z_to", 2**62))
        self.key = options.get("key")

    def _may_hold(self, path: str) -> bool:
        """By name: a file starts before z_to, and a range doesn't end before z_from."""
        m = re.search(r"(\d+)-(\d+)\D*$", path.rsplit("/", 1)[-1])
        return first_z(path) < self.z_to and not (m and int(m.group(2)) < self.z_from)

    def partitions(self) -> list[InputPartition]:
        fs, at = _open(self.root)
        info = fs.get_file_info(at)
        files = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
        paths = sorted(f.path for f in files if f.is_file and any(f.path.endswith(s) for s in CODECS) and self._may_hold(f.path))
        prefix = self.root[: len(self.root) - len(at)] if "://" in self.root else ""
        return [_File(prefix + p) for p in paths]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for when there are no partitions
            return
        fs, at = _open(partition.path)
        first = first_z(at)
        with fs.open_input_file(at) as f:
            if at.endswith(".npy") and first < self.z_from:
                shape = _shape(f.read(HEADER))
                if shape and first + (shape[0] if len(shape) == 3 else 1) <= self.z_from:
                    return
                f.seek(0)
            data = f.read()
        array = CODECS[next(s for s in CODECS if at.endswith(s))](data, self.key)
        array = array.reshape((1,) * (3 - array.ndim) + array.shape)
        for k in range(max(0, self.z_from - first), min(array.shape[0], self.z_to - first)):
            rows = [r.astype(float) for r in array[k]]
            yield pa.record_batch({"path": [partition.path] * len(rows), "z": pa.array([first + k] * len(rows), pa.int64()), "row": pa.array(range(len(rows)), pa.int64()), "px": pa.array(rows, pa.list_(pa.float64()))})


def _shape(head: bytes) -> tuple | None:
    """The shape that a .npy file's first bytes tell, if they hold all of its header."""
    f = io.BytesIO(head)
    try:
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(np.lib.format.read_magic(f))
        return read(f)[0] if read else None
    except ValueError:
        return None


class ArrayFiles(DataSource):
    """Numbered array files; z starts at first_z() of the file's name."""

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayFiles)


def numbered(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds z, the number at the end of a file's name; of files with one z the last name counts."""
    z = F.regexp_extract(F.col(path), r"(\d+)\D*(?:\.[A-Za-z0-9]+)?$", 1)
    rows = files.where(z != "").withColumn("z", z.cast("long"))
    last = F.row_number().over(Window.partitionBy("z").orderBy(F.desc(path)))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def z_range(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds z0 and z1 from names that end in <z0>-<z1>."""
    part = lambda k: F.regexp_extract(F.col(path), r"(\d+)-(\d+)\D*(?:\.[A-Za-z0-9]+)?$", k)
    return files.where(part(1) != "").withColumns({"z0": part(1).cast("long"), "z1": part(2).cast("long")})


def pair_chunks(volumes: DataFrame, probabilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of the two kinds that cover the same range, in order, and those without a partner."""
    a = z_range(volumes.withColumnRenamed("path", "volume"), "volume")
    b = z_range(probabilities.withColumnRenamed("path", "probability"), "probability")
    return a.join(b, ["z0", "z1"]).orderBy("z0"), a.join(b, ["z0", "z1"], "left_anti")


def resume(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has not been written yet."""
    return wanted.join(done, keys, "left_anti")


def merge_caches(caches: list[DataFrame], windows: list[tuple[float, float]], seam: str = "seam", z: str = "z", tolerance: float = 1e-4) -> DataFrame:
    """Caches united, each cut to its range of z; they must agree on the seam and not repeat a z."""
    parts = [c.where((F.col(z) >= lo) & (F.col(z) < hi)) for c, (lo, hi) in zip(caches, windows, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    lo, hi, n, distinct = out.agg(F.min(seam), F.max(seam), F.count(z), F.count_distinct(z)).first()
    if n and hi - lo > tolerance:
        raise ValueError(f"the caches' seams differ by {hi - lo}")
    if n != distinct:
        raise ValueError("the caches repeat a z")
    return out
