"""The transactional array sink, the archive source, and searches in levels."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import search
from lamina.sources import array_sets


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


def test_sets_are_written_whole_and_again(spark, tmp_path):
    rows = [(f"a/{k}", n, s, [float(k + i) for i in range(6)]) for k in range(5) for n, s in (("x", [2, 3]), ("y", None))]
    df = spark.createDataFrame(rows, "file string, name string, shape array<int>, values array<double>")
    for _ in range(2):
        array_sets.write_array_sets(df.repartition(3), f"file://{tmp_path}")
    assert files(tmp_path) == [f"a/{k}.npz" for k in range(5)]
    got = array_sets.read_array_set((tmp_path / "a/3.npz").read_bytes())
    assert got.keys() == {"x", "y"} and np.array_equal(got["x"], [[3, 4, 5], [6, 7, 8]]) and got["y"].shape == (6,)
    array_sets.write_array_sets(df.where("file = 'a/1'"), str(tmp_path), mode="overwrite")
    assert files(tmp_path) == ["a/1.npz"]
    array_sets.write_array_sets(df.limit(0), str(tmp_path))
    assert files(tmp_path) == ["a/1.npz"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([("good", "x", [2], [1.0, None]), ("bad", "x", [3], [1.0, 2.0])], "file string, name string, shape array<int>, values array<double>")
    with pytest.raises(Exception, match="reshape"):
        array_sets.write_array_sets(df, str(tmp_path))
    assert files(tmp_path) == []
    array_sets.write_array_sets(df.where("file = 'good'"), str(tmp_path))
    assert np.isnan(array_sets.read_array_set((tmp_path / "good.npz").read_bytes())["x"][1])


def npy(a):
    import io

    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def test_members_by_range(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "roll.zip", "w") as z:
        for k in range(40):
            z.writestr(f"scan/slice_{k:04d}.npy", npy(np.full((2, 3), k)), zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        z.writestr("readme.txt", "no array")
    array_sets.register(spark)
    read = lambda **o: spark.read.format("zip_arrays").options(path=str(tmp_path), **o).load()
    got = read(z_from=10, z_to=13).collect()
    assert sorted((r.z, r.row, r.px) for r in got) == [(k, y, [float(k)] * 3) for k in (10, 11, 12) for y in (0, 1)]
    assert read().select("z").distinct().count() == 40 and read(z_from=99).count() == 0
    parts = array_sets._ZipReader({"path": str(tmp_path), "z_from": "10", "z_to": "13"}).partitions()
    assert [m[0][-8:-4] for p in parts for m in p.members] == ["0010", "0011", "0012"]


def test_only_asked_members_are_fetched(tmp_path, monkeypatch):
    """Bytes read from the archive: those of the members and their headers."""
    big = np.random.default_rng(0).normal(size=(1, 50_000))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(9):
            z.writestr(f"s_{k}.npy", npy(big if k != 4 else big[:, :10]))
    reader = array_sets._ZipReader({"path": str(tmp_path / "a.zip"), "z_from": "4", "z_to": "5"})
    (part,) = reader.partitions()
    opened = array_sets._open
    seen = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            seen.append(n)
            return self.f.read(n)

    class Store:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, at):
            return Counting(self.fs.open_input_file(at))

    monkeypatch.setattr(array_sets, "_open", lambda p: (Store(opened(p)[0]), opened(p)[1]))
    assert sum(b.num_rows for b in reader.read(part)) == 1 and sum(seen) < 1000


def test_levels_find_planted_scales(spark):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[:32, :32]
    bumps = [(rng.uniform(8, 24), rng.uniform(8, 24), rng.uniform(2, 3)) for _ in range(6)]
    picture = lambda sy, sx: sum(np.exp(-(((15.5 + (y - 15.5) / sy - a) / s) ** 2) - ((15.5 + (x - 15.5) / sx - b) / s) ** 2) for a, b, s in bumps)
    true = {1: (1.0, 1.0), 2: (1.15, 0.9), 3: (0.95, 1.1)}
    rows = [(k, picture(*s).ravel().tolist(), picture(1, 1).ravel().tolist()) for k, s in true.items()] + [(4, None, [0.0] * 1024)]
    got = {r.k: r for r in search.align_scales(spark.createDataFrame(rows, "k int, a array<double>, b array<double>"), ["k"], "a", "b", (32, 32), step=0.1).collect()}
    assert got.keys() == set(true)
    for k, (sy, sx) in true.items():
        assert abs(got[k].sy - sy) < 0.02 and abs(got[k].sx - sx) < 0.02 and got[k].score > 0.98


def test_levels_ties_and_gaps(spark):
    things = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    score = lambda g: g.where("k < 3").withColumn("score", F.when(F.col("k") == 1, -F.abs(F.col("p") - 0.37)).when(F.col("p") < 0.5, F.lit(1.0)).otherwise(F.lit(float("nan"))))
    got = {r.k: (r.p, r.score) for r in search.search_levels(things, ["k"], {"p": (0.0, 1.0, 0.25)}, score, 3, 5).collect()}
    assert got == {1: (pytest.approx(0.37), pytest.approx(0.0, abs=1e-9)), 2: (0.0, 1.0)}
    assert search.search_levels(things.limit(0), ["k"], {"p": (0.0, 1.0, 0.25)}, score).count() == 0
