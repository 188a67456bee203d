import pytest

from lamina.llm import common


class _Cluster:
    """A session as a cluster without a shared folder has it."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "spark://host:7077"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(_Cluster)


def test_paths_without_a_scheme_lie_on_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert common.qualified(spark, "/shared/x") == "file:///shared/x" and common.qualified(spark, "file:/shared/x") == "file:///shared/x"
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./in", "file:///tmp")
    try:
        assert common.qualified(spark, "/in/x") == "viewfs://store/in/x"
    finally:
        conf.unset("fs.defaultFS")


def test_parked_tables(spark):
    df = common.park(spark.range(10).selectExpr("id * 2 AS id"))
    assert df.count() == 10 and df.storageLevel.useDisk and not df.storageLevel.useMemory
    common.drop(df)
    assert not df.storageLevel.useDisk
