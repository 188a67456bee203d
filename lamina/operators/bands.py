"""Seeds, checks and measures of bands along rays and rows. Null values count as no band; keys
without rows give none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.semantics import TWO_PI, lerp, median, ordered
from lamina.operators.matching import banded
from lamina.operators import matching
from lamina.operators.ordered import runs


def seed_ray_by_count(bands: DataFrame, anchor: str, ray: str, share: float = 0.995) -> DataFrame:
    """The bands of the first (anchor, ray) that has just as many as the floor of that percentile of
    all rays' counts; none, if no ray has."""
    n = bands.groupBy(anchor, ray).agg(F.count("*").alias("n"))
    wanted = n.agg(F.floor(F.percentile("n", F.lit(share))).alias("_want"))  # one row
    first = n.join(F.broadcast(wanted), F.col("n") == F.col("_want")).orderBy(anchor, ray).limit(1).select(anchor, ray, "n")
    return bands.join(F.broadcast(first), [anchor, ray])


def winding_seeds(points: DataFrame, keys: list[str], phi: str, r: str, at: float, near: float, gap: float) -> DataFrame:
    """Radii within ``near`` of an azimuth, parted where neighbours are ``gap`` or more apart: keys,
    winding (from 0), r (median) and n."""
    off = F.abs(F.pmod(F.col(phi) - at + TWO_PI / 2, F.lit(TWO_PI)) - TWO_PI / 2)
    close = points.where((off <= near) & F.col(r).isNotNull())
    w = ordered(keys, r)
    new = F.coalesce((F.col(r) - F.lag(r).over(w) >= gap).cast("int"), F.lit(0))
    parted = close.withColumn("_new", new).withColumn("winding", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parted.groupBy(*keys, "winding").agg(median(F.col(r)).alias("r"), F.count("*").alias("n"))


def ring_check(predicted: DataFrame, bands: DataFrame, keys: list[str], r: str, eps: float) -> DataFrame:
    """Predicted radii against true bands within ``eps``: keys, skipped (bands without a
    prediction), doubled (bands with several) and lone (predictions without a band)."""
    p = predicted.select(*keys, F.col(r).alias("_p")).withColumn("_pid", F.row_number().over(ordered(keys, "_p")))
    b = bands.select(*keys, F.col(r).alias("_b")).withColumn("_bid", F.row_number().over(ordered(keys, "_b")))
    met = matching.banded(p, b, keys, "_p", "_b", eps)
    of_band, of_guess = met.groupBy(*keys, "_bid").agg(F.count("*").alias("_n")), met.select(*keys, "_pid").distinct().withColumn("_hit", F.lit(1))
    band = b.join(of_band, [*keys, "_bid"], "left").groupBy(*keys).agg(F.count_if(F.col("_n").isNull()).alias("skipped"), F.count_if(F.col("_n") > 1).alias("doubled"))
    guess = p.join(of_guess, [*keys, "_pid"], "left").groupBy(*keys).agg(F.count_if(F.col("_hit").isNull()).alias("lone"))
    none = F.lit(0).cast("long")
    return band.join(guess, keys, "full").select(*keys, *[F.coalesce(c, none).alias(c) for c in ("skipped", "doubled", "lone")])


def gap_profile(cells: DataFrame, keys: list[str], order: str, on: Column) -> DataFrame:
    """How often the band ends along each ray: keys, ends. A band that reaches the last sample
    doesn't end."""
    after = cells.withColumn("_on", F.coalesce(on, F.lit(False))).withColumn("_next", F.lead("_on").over(ordered(keys, order)))
    return after.groupBy(*keys).agg(F.count_if(F.col("_on") & ~F.col("_next")).alias("ends"))


def flatness(cells: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The deviation of what a mean of three takes off, and the 99th percentile of the steps: keys,
    rough, steepest."""
    w = ordered(keys, order)
    parts = cells.withColumns({"_h": F.col(value) - F.avg(value).over(w.rowsBetween(-1, 1)), "_s": F.abs(F.col(value) - F.lag(value).over(w))})
    return parts.groupBy(*keys).agg(F.stddev_pop("_h").alias("rough"), F.percentile("_s", F.lit(0.99)).alias("steepest"))


def band_pair(peaks: DataFrame, keys: list[str], at: str, height: str, apart: float, slack: float) -> DataFrame:
    """Of two peaks about ``apart`` from each other the pair of the largest heights less the share by
    which their distance is off (ties: the first): keys, lo, hi, score."""
    a, b = (peaks.select(*keys, F.col(at).alias(n), F.col(height).alias(f"_{n}")) for n in ("lo", "hi"))
    off = F.abs(F.col("hi") - F.col("lo") - apart)
    near = banded(a.withColumn("_to", F.col("lo") + apart), b, keys, "_to", "hi", slack)
    pairs = near.where(F.col("hi") > F.col("lo")).withColumn("score", F.col("_lo") + F.col("_hi") - off / apart)
    first = F.row_number().over(ordered(keys, F.desc("score"), "lo", "hi"))
    return pairs.withColumn("_k", first).where("_k = 1").select(*keys, "lo", "hi", "score")


def widest_bands(profile: DataFrame, keys: list[str], order: str, value: str, least: int, n: int = 2) -> DataFrame:
    """The ``n`` longest runs (ties: the first) of at least ``least`` samples above half the largest
    value: keys, lo, hi, n and complete, whether there are as many."""
    top = profile.groupBy(*keys).agg(F.max(value).alias("_top"))
    found = runs(profile.join(top, keys), keys, order, F.col(value) > F.col("_top") / 2, least, count_samples=True)
    rank = F.row_number().over(ordered(keys, F.desc("n"), "lo"))
    kept = found.withColumn("_k", rank).where(F.col("_k") <= n)
    return kept.withColumn("complete", F.count("*").over(Window.partitionBy(*keys)) >= n).select(*keys, "lo", "hi", "n", "complete")


def median_sharpness(frames: DataFrame, keys: list[str], row: str, col: str, value: str) -> DataFrame:
    """The mean squared step of the median of all frames, along rows and columns: keys, sharpness."""
    still = frames.groupBy(*keys, row, col).agg(median(F.col(value)).alias("_m"))
    steps = still.select(*keys, *[(F.lead("_m").over(ordered([*keys, a], b)) - F.col("_m")).alias(n) for n, a, b in (("_x", row, col), ("_y", col, row))])
    return steps.groupBy(*keys).agg((F.avg(F.col("_x") * F.col("_x")) + F.avg(F.col("_y") * F.col("_y"))).alias("sharpness"))


def shear(cells: DataFrame, keys: list[str], row: str, col: str, value: str, slant: float, width: int) -> DataFrame:
    """Each row read ``slant`` columns further along for each row down, between columns, the ends
    held: keys, row, col, value."""
    at = F.least(F.greatest(F.col(col) + slant * F.col(row), F.lit(0.0)), F.lit(float(width - 1)))
    places = cells.select(*keys, row, col, at.alias("_at")).withColumn("_c", F.least(F.floor("_at"), F.lit(max(width - 2, 0))).cast("int"))
    a, b = (cells.select(*keys, row, (F.col(col) - d).cast("int").alias("_c"), F.col(value).alias(n)) for d, n in ((0, "_a"), (1, "_b")))
    both = places.join(a, [*keys, row, "_c"]).join(b, [*keys, row, "_c"], "left")
    return both.select(*keys, row, col, lerp(F.col("_a"), F.coalesce("_b", "_a"), F.col("_at") - F.col("_c")).alias(value))
