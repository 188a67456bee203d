"""Sets of arrays as files: a transactional sink that writes many .npz files, each of several arrays, and a
source that reads chosen members of zip archives.

``write_array_sets(df, path)`` takes rows (file, name, shape, values). Tasks write into a folder of their
own job, and only the driver's commit moves finished files into place; a task or job that fails leaves
none. A repeated run replaces its files.

``spark.read.format("zip_arrays")`` (after register()) with option path reads members of one archive or of
a folder of them as rows (path, member, z, row, px), as array_files does with files; z_from and z_to
(exclusive) bound the number at the end of a member's name. Members are found in the archive's directory on
the driver and read by their offsets, so others' bytes are never fetched."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lamina.sources.rasters import CODECS, _open, first_z

#: Bytes of a member's local header before its name.
LOCAL = 30
#: Members that one partition reads.
MEMBERS = 16


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file lies, and its name in the set


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.job, self.overwrite = options["path"].rstrip("/"), uuid.uuid4().hex, overwrite

    def _temporary(self, at: str) -> str:
        return f"{at}/_temporary-{self.job}"

    def write(self, iterator: Iterator) -> _Written:
        fs, at = _open(self.root)
        own = f"{self._temporary(at)}/{uuid.uuid4().hex}"
        fs.create_dir(own, recursive=True)
        done: list[tuple[str, str]] = []
        name = archive = sink = None
        try:
            for r in iterator:
                if r["file"] != name:
                    if archive:
                        archive.close()
                        sink.close()
                    name = r["file"]
                    path = f"{own}/{len(done)}"
                    sink = fs.open_output_stream(path)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                    done.append((path, name))
                a = np.asarray(r["values"], float).reshape(r["shape"] if r["shape"] is not None else -1)
                with archive.open(f"{r['name']}.npy", "w", force_zip64=True) as member:
                    np.lib.format.write_array(member, a, allow_pickle=False)
        finally:
            if archive:
                archive.close()
                sink.close()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, at = _open(self.root)
        if self.overwrite:
            old = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True, allow_not_found=True))
            for f in old:
                if f.is_file and f.path.endswith(".npz") and "/_temporary-" not in f.path:
                    fs.delete_file(f.path)
        for path, name in (x for m in messages if m for x in m.files):
            to = f"{at}/{name}.npz"
            fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
            if fs.get_file_info(to).is_file:
                fs.delete_file(to)
            fs.move(path, to)
        self._sweep(fs, at)

    def abort(self, messages: list[_Written | None]) -> None:
        self._sweep(*_open(self.root))

    def _sweep(self, fs, at: str) -> None:
        if fs.get_file_info(self._temporary(at)).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(self._temporary(at))


class ArraySets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_sets"

    def schema(self) -> str:
        return "file string, name string, shape array<int>, values array<double>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def write_array_sets(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows (file, name, shape, values) as ``path``/<file>.npz, one array for each row. All rows of a file
    go to one task, one at a time: a file is what fits a task's disk, an array what fits its memory. A
    null shape means one dimension, null samples are NaN; rows without file, name or values are an error.
    mode append keeps other files, overwrite removes the set's older ones on commit."""
    register(df.sparkSession)
    rows = df.selectExpr("file", "name", "CAST(shape AS array<int>) AS shape", "CAST(values AS array<double>) AS values")
    rows.repartition("file").sortWithinPartitions("file", "name").write.format("array_sets").mode(mode).option("path", path).save()


@dataclass
class _Members(InputPartition):
    path: str
    members: list[tuple[str, int, int, int]]  # name, offset of its header, bytes, method


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.z_from, self.z_to, self.key = options["path"], int(options.get("z_from", 0)), int(options.get("z_to", 2**62)), options.get("key")

    def partitions(self) -> list[InputPartition]:
        fs, at = _open(self.root)
        info = fs.get_file_info(at)
        files = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
        prefix = self.root[: len(self.root) - len(at)] if "://" in self.root else ""
        out: list[InputPartition] = []
        for path in sorted(f.path for f in files if f.is_file and f.path.endswith(".zip")):
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                wanted = [(m.filename, m.header_offset, m.compress_size, m.compress_type) for m in z.infolist() if any(m.filename.endswith(s) for s in CODECS) and self.z_from <= first_z(m.filename) < self.z_to]
            wanted.sort(key=lambda m: m[1])
            out += [_Members(prefix + path, wanted[k : k + MEMBERS]) for k in range(0, len(wanted), MEMBERS)]
        return out

    def read(self, partition: _Members | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for when there are no partitions
            return
        fs, at = _open(partition.path)
        with fs.open_input_file(at) as f:
            for name, offset, size, method in partition.members:
                f.seek(offset)
                head = f.read(LOCAL)
                f.seek(offset + LOCAL + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
                data = f.read(size)
                if method == zipfile.ZIP_DEFLATED:
                    data = zlib.decompress(data, -15)
                elif method != zipfile.ZIP_STORED:
                    raise ValueError(f"{name}: compression {method} is not read")
                a = CODECS[next(s for s in CODECS if name.endswith(s))](data, self.key)
                a = a.reshape((1,) * (3 - a.ndim) + a.shape)
                for k, slice_ in enumerate(a):
                    n = len(slice_)
                    yield pa.record_batch({"path": [partition.path] * n, "member": [name] * n, "z": pa.array([first_z(name) + k] * n, pa.int64()), "row": pa.array(range(n), pa.int64()), "px": pa.array([r.astype(float) for r in slice_], pa.list_(pa.float64()))})


class ZipArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_arrays"

    def schema(self) -> str:
        return "path string, member string, z long, row long, px array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArraySets)
    spark.dataSource.register(ZipArrays)


def read_array_set(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of one file of a set."""
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}
