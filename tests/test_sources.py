import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.plans.spiral import Spiral, generate, profiles, trace
from lamina.sources import rasters, sinks, splits
from lamina.streaming.tracker import gap_sessions, track_stream


def test_array_files(spark, tmp_path):
    rasters.register(spark)
    a = np.arange(24.0).reshape(2, 3, 4)
    np.save(tmp_path / "volume_0010.npy", a)
    np.save(tmp_path / "slice_0007.npy", a[0])
    got = spark.read.format("array_files").load(str(tmp_path)).collect()
    assert {(r.z, r.row): list(r.px) for r in got} == {(10 + k, i): a[k, i].tolist() for k in range(2) for i in range(3)} | {(7, i): a[0, i].tolist() for i in range(3)}
    assert spark.read.format("array_files").option("z_from", 11).load(str(tmp_path)).count() == 3


def test_archives_and_files_outside_the_range(spark, tmp_path):
    rasters.register(spark)
    a = np.arange(24.0).reshape(2, 3, 4)
    np.savez(tmp_path / "cache_0003.npz", other=a[0] * 0, strip=a[1])
    read = lambda **o: spark.read.format("array_files").options(**o).load(str(tmp_path))
    assert [list(r.px) for r in read(key="strip").orderBy("row").collect()] == a[1].tolist()
    assert {x for r in read().collect() for x in r.px} == {0.0}
    np.save(tmp_path / "volume_0010-0011.npy", a)
    np.save(tmp_path / "slice_0007.npy", a[0])
    (tmp_path / "volume_0020-0039.npy").write_bytes(b"not an array: it must not be opened")
    (tmp_path / "slice_0050.npy").write_bytes(b"nor this one")
    assert sorted({r.z for r in read(z_from=8, z_to=20).collect()}) == [10, 11]
    assert [p.path.rsplit("/", 1)[1] for p in rasters._Reader({"path": str(tmp_path), "z_from": "11", "z_to": "20"}).partitions()] == ["cache_0003.npz", "slice_0007.npy", "volume_0010-0011.npy"]
    assert sorted({r.z for r in read(z_from=11, z_to=20).collect()}) == [11]
    assert rasters._shape((tmp_path / "slice_0007.npy").read_bytes()) == (3, 4) and rasters._shape(b"junk of some length") is None


def test_discovery(spark):
    v = spark.createDataFrame([("a/vol_0000-0019.h5",), ("a/vol_0020-0039.h5",)], "path string")
    p = spark.createDataFrame([("b/p_0020-0039.h5",)], "path string")
    pairs, lone = rasters.pair_chunks(v, p)
    assert [(r.z0, r.z1) for r in pairs.collect()] == [(20, 39)] and [r.z0 for r in lone.collect()] == [0]
    n = rasters.numbered(spark.createDataFrame([("x_0001.h5",), ("y_0001.h5",), ("none",)], "path string")).collect()
    assert [(r.path, r.z) for r in n] == [("y_0001.h5", 1)]


def test_merge_caches(spark):
    c = lambda zs, seam: spark.createDataFrame([(float(z), seam) for z in zs], "z double, seam double")
    assert rasters.merge_caches([c([0, 1, 2], 0.5), c([2, 3], 0.5)], [(0, 2), (2, 9)]).count() == 4
    with pytest.raises(ValueError, match="seams"):
        rasters.merge_caches([c([0], 0.5), c([1], 0.6)], [(0, 9), (0, 9)])
    with pytest.raises(ValueError, match="repeat"):
        rasters.merge_caches([c([0], 0.5), c([0], 0.5)], [(0, 9), (0, 9)])


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 2, [3.0, 4.0])], "c string, z int, v array<double>")
    got = sorted((r.z, list(r.v), r.filled) for r in sinks.reassemble(s, "c", "z", "v", 2).collect())
    assert got == [(0, [1, 2], False), (1, [0, 0], True), (2, [3, 4], False)]
    cells = spark.createDataFrame([(0, i, float(i)) for i in range(10)], "z int, col int, v double")
    b = sinks.to_blocks(cells, ["z"], "col", "v", 4)
    assert sorted(map(tuple, sinks.from_blocks(b, ["z"], 4).collect())) == sorted(map(tuple, cells.collect()))
    sinks.write_strip(b, f"{tmp_path}/strip", ["z"])
    assert spark.read.parquet(f"{tmp_path}/strip").count() == 3
    e = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, bytes long")
    f = spark.createDataFrame([("a", 1), ("b", 5), ("d", 1)], "path string, bytes long")
    assert {(r.path, r.problem) for r in sinks.manifest_errors(e, f).collect()} == {("b", "size"), ("c", "missing"), ("d", "unexpected")}


def test_folds(spark):
    items = spark.range(200).select((F.col("id") % 20).alias("volume"), "id")
    f = splits.grouped_folds(items, "volume", 5)
    assert f.groupBy("volume").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    train, test = splits.split(f, 0)
    assert train.count() + test.count() == 200
    assert splits.spread_subset(spark.range(10).withColumnRenamed("id", "i"), "i", 10, 0.5).count() == 5


def test_streamed_tracks_are_the_batch_ones(spark, tmp_path):
    s = Spiral(size=120, windings=3, slices=4)
    c = (s.size - 1) / 2
    p = profiles(trace(generate(spark, s), c, c, 19, 70), c, c).withColumn("roll", F.lit(1).cast("long")).persist()
    at = f"{tmp_path}/in"
    for z in range(4):
        p.where(F.col("z") == z).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(at)
    q = track_stream(stream, s.pitch / 2).writeStream.format("memory").queryName("tracks").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("tracks").collect()
    assert len(rows) == 12 and {r.track_id for r in rows} == {0, 1, 2}
    assert all(len({r.track_id for r in rows if r.z == z}) == 3 for z in range(4))


def test_sessions(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:03"), (1, "2024-01-01 00:01:00")], "k int, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in gap_sessions(e, ["k"], "t", "10 seconds", "1 minute").collect()) == [1, 2]
