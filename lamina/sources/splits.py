"""Splits of cases into folds, and subsets by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.semantics import portable_uniform, rint


def grouped_folds(items: DataFrame, parent: str, folds: int, seed: int = 42, hashed: bool = True) -> DataFrame:
    """Adds fold; all items of a parent share one, so none leaks between training and test."""
    if hashed:
        return items.withColumn("fold", F.floor(portable_uniform(F.col(parent), seed=seed) * folds).cast("int"))
    return items.withColumn("fold", F.pmod(F.col(parent), F.lit(folds)).cast("int"))


def split(items: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of one fold."""
    return items.where(F.col("fold") != fold), items.where(F.col("fold") == fold)


def spread_subset(df: DataFrame, index: str, n: int, share: float) -> DataFrame:
    """A share of the indices 0 .. n - 1, evenly spread and unique."""
    k = max(1, round(share * n))
    places = df.sparkSession.range(k).select(rint(F.col("id") * (n - 1) / max(1, k - 1)).cast("long").alias(index)).distinct()
    return df.join(places, index, "left_semi")


def middle_slice(chunks: DataFrame, z0: str = "z0", n: str = "n") -> DataFrame:
    """Adds the middle position of each chunk."""
    return chunks.withColumn("z_mid", F.col(z0) + F.floor(F.col(n) / 2))
