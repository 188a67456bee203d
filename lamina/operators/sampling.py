"""Reproducible samples, pairs and grids. Draws are hashes of keys, so they don't depend on how a
table is partitioned. Empty tables give no rows; rows with a null key are hashed without it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.semantics import portable_uniform


def z_pairs(points: DataFrame, keys: list[str], z: str, value: str, share: float, seed: int = 0) -> DataFrame:
    """A hashed share of the points, each with the value of the same keys one step further in z:
    keys, z, value, next. Points without a next one are left out."""
    after = points.select(*keys, (F.col(z) - 1).alias(z), F.col(value).alias("next"))
    drawn = points.where(portable_uniform(*map(F.col, keys), F.col(z), seed=seed) < share)
    return drawn.select(*keys, z, value).join(after, [*keys, z])


def _drawn(n: int, draws: int, items: int, spark: SparkSession, seed: int) -> DataFrame:
    """``n`` numbered rows of ``draws`` indices of ``items`` each, in an array."""
    index = lambda j: F.floor(portable_uniform(F.col("k"), F.lit(j), seed=seed) * items).cast("long")
    return spark.range(n).select(F.col("id").alias("k")).withColumn("drawn", F.array(*[index(j) for j in range(draws)]))


def inner_first_pairs(items: DataFrame, index: str, r: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` pairs of rows drawn by their index (0 to count - 1), the one of the smaller radius (ties:
    the smaller index) first: k, inner, outer. A row may meet itself."""
    rows = items.select(F.col(index).alias("_i"), F.col(r).alias("_r"))
    pairs = _drawn(n, 2, items.count(), items.sparkSession, seed).select("k", F.posexplode("drawn").alias("_j", "_i")).join(rows, "_i")
    both = pairs.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("_r", "_i"))).alias("p"))  # two rows
    return both.select("k", F.col("p")[0]["_i"].alias("inner"), F.col("p")[1]["_i"].alias("outer"))


def angular_pairs(items: DataFrame, index: str, r: str, n: int, near: float, candidates: int = 10, seed: int = 0) -> DataFrame:
    """``n`` reference rows, each with the nearest in radius (ties: the smaller index) of a few drawn
    candidates other than itself, if nearer than ``near``: k, one, other."""
    rows = items.select(F.col(index).alias("_i"), F.col(r).alias("_r"))
    drawn = _drawn(n, candidates + 1, items.count(), items.sparkSession, seed).select("k", F.col("drawn")[0].alias("one"), F.explode(F.slice("drawn", 2, candidates)).alias("other"))
    a, b = (rows.select(F.col("_i").alias(c), F.col("_r").alias(f"_{c}")) for c in ("one", "other"))
    gaps = drawn.where("one <> other").join(a, "one").join(b, "other").withColumn("_g", F.abs(F.col("_one") - F.col("_other"))).where(F.col("_g") < near)
    best = gaps.groupBy("k", "one").agg(F.min(F.struct("_g", "other")).alias("_b"))
    return best.select("k", "one", F.col("_b.other").alias("other"))


def stratified(df: DataFrame, by: list[str], strata: list[tuple[Column, float]], seed: int = 0) -> DataFrame:
    """Rows drawn by hash with the share of the first stratum that they are in; others are left out.
    Adds stratum."""
    share, stratum = F.lit(None).cast("double"), F.lit(None).cast("int")
    for k, (where, s) in reversed(list(enumerate(strata))):
        share, stratum = F.when(where, F.lit(s)).otherwise(share), F.when(where, F.lit(k)).otherwise(stratum)
    return df.withColumn("stratum", stratum).where(portable_uniform(*map(F.col, by), seed=seed) < share)


def uv_grid(spark: SparkSession, columns: int, rows: int) -> DataFrame:
    """A dense grid: row, col, and u from 0 to 1 along the columns."""
    u = F.col("col") / (columns - 1) if columns > 1 else F.lit(0.0)
    return spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("long").alias("row"), (F.col("id") % columns).alias("col")).withColumn("u", u.cast("double"))
