"""Sinks: arrays cut into slices and put together again, strips in blocks, reports, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_slices(volumes: DataFrame, parent: str, slices: str) -> DataFrame:
    """An item for each slice of a volume, keyed by parent and z."""
    others = [c for c in volumes.columns if c != slices]
    return volumes.select(*others, F.posexplode(slices).alias("z", "slice"))


def reassemble(slices: DataFrame, parent: str, z: str, values: str, size: int) -> DataFrame:
    """Slices of each parent in order from 0; a missing one is zeros: parent, z, values, filled."""
    last = slices.groupBy(parent).agg(F.max(z).alias("_last"))
    grid = last.select(parent, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))).alias(z))
    rows = grid.join(slices.withColumn(z, F.col(z).cast("long")), [parent, z], "left")
    return rows.select(parent, z, F.coalesce(F.col(values), F.array_repeat(F.lit(0.0), size)).alias(values), F.col(values).isNull().alias("filled"))


def to_blocks(strip: DataFrame, keys: list[str], col: str, value: str, width: int) -> DataFrame:
    """Long cells as rows of ``width`` columns: keys, block, v."""
    packed = strip.groupBy(*keys, F.floor(F.col(col) / width).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct(col, value))).alias("_c"))
    return packed.select(*keys, "block", F.transform("_c", lambda c: c[value]).alias("v"))


def from_blocks(blocks: DataFrame, keys: list[str], width: int) -> DataFrame:
    return blocks.select(*keys, "block", F.posexplode("v").alias("_i", "v")).select(*keys, (F.col("block") * width + F.col("_i")).alias("col"), "v")


def write_strip(blocks: DataFrame, path: str, by: list[str]) -> None:
    """Parquet partitioned by ``by``; a rerun replaces only the partitions that it writes."""
    blocks.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def manifest_errors(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Where two manifests (path, bytes) differ: path, problem."""
    e, f = expected.select("path", F.col("bytes").alias("want")), found.select("path", F.col("bytes").alias("have"))
    twice = found.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("repeated").alias("problem"))
    j = e.join(f, "path", "full")
    kind = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "size")
    return j.select("path", kind.alias("problem")).where("problem IS NOT NULL").distinct().union(twice)


def report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document for each key."""
    others = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*others)).alias("report"))
