"""Operators composed of the others: layers, centres, cells, templates, rails, drift of ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.semantics import MAD_SCALE, TWO_PI, clip, histogram_bin, median, ordered, ratio, rint
from lamina.operators import aggregates, interp, matching, ordered as series


def assign_layers(points: DataFrame, layers: DataFrame, keys: list[str], bins: int, least: float = 3.0, share: float = 0.3) -> DataFrame:
    """Points (r, theta) given the nearest layer (k, bin, r, thick) of their angle bin within
    max(``least``, ``share`` of its thickness): adds k and gap; without one they are left out."""
    p = points.withColumn("bin", F.pmod(F.floor(F.col("theta") / TWO_PI * bins), F.lit(bins)).cast("int"))
    near = p.join(layers.select(*keys, "bin", "k", F.col("r").alias("_r"), "thick"), [*keys, "bin"])
    near = near.withColumn("gap", F.abs(F.col("r") - F.col("_r"))).where(F.col("gap") <= F.greatest(F.lit(least), share * F.col("thick")))
    own = points.columns
    best = near.groupBy(*own).agg(F.min(F.struct("gap", "k")).alias("_b"))
    return best.select(*own, F.col("_b.k").alias("k"), F.col("_b.gap").alias("gap"))


def bin_to_boundaries(points: DataFrame, boundaries: DataFrame, keys: list[str], r: str) -> DataFrame:
    """Adds k, the number of the key's boundaries at or below a radius. A key has as many
    boundaries as windings, so they travel as one array; points are not sorted."""
    b = boundaries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("r").cast("double"))).alias("_b"))
    joined = points.join(b, keys, "left") if keys else points.join(F.broadcast(b))  # one row without keys
    return joined.withColumn("k", F.coalesce(F.size(F.filter("_b", lambda x: x <= F.col(r))), F.lit(0)).cast("long")).drop("_b")


def refit_centres(centres: DataFrame, keys: list[str], z: str, columns: list[str], rounds: int = 5, limit: float = 3.0, floor: float = 0.5) -> DataFrame:
    """Centres over z whose coordinates stray from a clipped line, replaced by interpolation between
    the ones that don't: keys, z, columns, origin. If fewer than half would stay, all do."""
    rows = centres.select(*keys, z, *columns)
    good = None
    for c in columns:
        fit = aggregates.clipped_line(rows, keys, z, c, rounds, limit, floor).select(*keys, z, F.col("used").alias(f"_u_{c}"))
        rows = rows.join(fit, [*keys, z])
        good = F.col(f"_u_{c}") if good is None else good & F.col(f"_u_{c}")
    rows = rows.withColumn("_good", good)
    share = F.avg(F.col("_good").cast("int")).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_keep", F.col("_good") | (share < 0.5))
    for c in columns:
        rows = series.fill_between(rows, keys, z, F.when(F.col("_keep"), F.col(c)), c)
    return rows.select(*keys, z, *columns, F.when(F.col("_keep"), "measured").otherwise("interpolated").alias("origin"))


def ladder_gaps(paths: DataFrame, keys: list[str], winding: str, radius: str) -> DataFrame:
    """Median radius of each winding and its gap to the next: keys, winding, r, gap."""
    r = paths.groupBy(*keys, winding).agg(median(F.col(radius)).alias("r"))
    return r.withColumn("gap", F.lead("r").over(ordered(keys, winding)) - F.col("r"))


def crossings(profiles: DataFrame, keys: list[str], winding: str, bin_: str, radius: str, least: float) -> DataFrame:
    """For each azimuth bin how many neighbouring windings come nearer than ``least``, or cross."""
    nxt = profiles.select(*keys, (F.col(winding) - 1).alias(winding), bin_, F.col(radius).alias("_n"))
    gap = F.col("_n") - F.col(radius)
    return profiles.join(nxt, [*keys, winding, bin_]).groupBy(*keys, bin_).agg(F.count_if(gap < least).alias("close"), F.count_if(gap < 0).alias("crossed"), F.count("*").alias("pairs"))


def walk_quality(paths: DataFrame, keys: list[str], order: str, x: str, y: str, jump: float, kink: float) -> DataFrame:
    """Of each path: points, steps longer than ``jump``, turns sharper than ``kink`` radians, length."""
    w = ordered(keys, order)
    steps = paths.withColumns({"_dx": F.col(x) - F.lag(x).over(w), "_dy": F.col(y) - F.lag(y).over(w)})
    steps = steps.withColumns({"_l": F.hypot("_dx", "_dy"), "_a": F.atan2("_dy", "_dx")})
    turn = F.abs(F.pmod(F.col("_a") - F.lag("_a").over(w) + TWO_PI / 2, F.lit(TWO_PI)) - TWO_PI / 2)
    steps = steps.withColumn("_t", turn)
    return steps.groupBy(*keys).agg(F.count("*").alias("points"), F.count_if(F.col("_l") > jump).alias("jumps"), F.count_if(F.col("_t") > kink).alias("kinks"), F.coalesce(F.sum("_l"), F.lit(0.0)).alias("length"))


def cut_cells(profile: DataFrame, bounds: DataFrame, keys: list[str], at: str, bucket: float | None = None) -> DataFrame:
    """Columns of a strip given the cell between neighbouring bounds that they fall in: adds cell, c_lo
    and c_hi. Cells don't overlap, so a column's is that of the last bound at or before it; no row is
    repeated, however wide the cells are, and ``bucket`` is not needed."""
    b = bounds.select(*keys, F.col("at").cast("double").alias("c_lo")).withColumns({"cell": F.row_number().over(ordered(keys, "c_lo")) - 1, "c_hi": F.lead("c_lo").over(ordered(keys, "c_lo"))})
    b = b.where("c_hi IS NULL OR c_hi > c_lo")  # of equal bounds the last one; the last of all ends the cells
    known = profile.where(F.col(at).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    found = matching.asof(known.withColumn("_at", F.col(at).cast("double")), b.withColumnRenamed("c_lo", "_at"), keys, "_at", ["cell", "c_hi"])
    return found.where("c_hi IS NOT NULL").select(*profile.columns, F.col("_at_right").alias("c_lo"), "cell", "c_hi")


def template(cells: DataFrame, keys: list[str], cell: str, offset: str, value: str, least: int = 5) -> DataFrame:
    """The median of aligned windows at each offset; nothing from fewer than ``least`` windows."""
    n = cells.groupBy(*keys).agg(F.count_distinct(cell).alias("_n")).where(F.col("_n") >= least)
    return cells.join(n, keys, "left_semi").groupBy(*keys, offset).agg(median(F.col(value)).alias("template"))


def template_score(cells: DataFrame, templates: DataFrame, keys: list[str], cell: str, offset: str, value: str) -> DataFrame:
    """Correlation of each window with the template of its key."""
    j = cells.join(templates, [*keys, offset])
    return j.groupBy(*keys, cell).agg(F.corr(F.col(value), F.col("template")).alias("score"))


def merge_edges(edges: DataFrame, keys: list[str], at: str, within: float) -> DataFrame:
    """Places nearer to the one before than ``within`` become one, at their mean."""
    w = ordered(keys, at)
    g = edges.withColumn("_new", F.coalesce((F.col(at) - F.lag(at).over(w) >= within).cast("int"), F.lit(0)))
    g = g.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*keys, "_g").agg(F.avg(at).alias(at), F.count("*").alias("n")).drop("_g")


def fuse_rails(a: DataFrame, b: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Two series of the same quantity weighted by the inverse of their noise (from second
    differences); where one lacks an index the other alone counts."""
    na, nb = (series.second_difference_noise(s, keys, index, value).withColumnRenamed("noise", f"_n{n}") for n, s in (("a", a), ("b", b)))
    one = a.select(*keys, index, F.col(value).alias("_a")).join(b.select(*keys, index, F.col(value).alias("_b")), [*keys, index], "full").join(na, keys, "left").join(nb, keys, "left")
    weight = lambda n: 1 / F.greatest(F.coalesce(F.col(f"_n{n}"), F.lit(1.0)) * F.coalesce(F.col(f"_n{n}"), F.lit(1.0)), F.lit(1e-12))
    both = (F.col("_a") * weight("a") + F.col("_b") * weight("b")) / (weight("a") + weight("b"))
    return one.select(*keys, index, F.coalesce(both, F.col("_a"), F.col("_b")).alias(value), F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "first").otherwise("second").alias("origin"))


def residual_agreement(a: DataFrame, b: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Correlation of the leave-one-out residuals of two series on their common indices."""
    ra, rb = (series.leave_one_out(s, keys, index, value).select(*keys, index, F.col("residual").alias(n)) for n, s in (("_a", a), ("_b", b)))
    return ra.join(rb, [*keys, index]).where("_a IS NOT NULL AND _b IS NOT NULL").groupBy(*keys).agg(F.corr("_a", "_b").alias("corr"), F.count("*").alias("n"))


def hold_out_error(df: DataFrame, keys: list[str], z: str, value: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key predicted from the others by holding the last value, by a line
    and by interpolation's end: mean absolute error of each way."""
    rank = F.row_number().over(ordered(keys, F.desc(z)))
    rows = df.select(*keys, z, value, rank.alias("_k"))
    train, test = rows.where(F.col("_k") > n), rows.where(F.col("_k") <= n)
    last = train.groupBy(*keys).agg(F.max(F.struct(F.col(z), F.col(value))).alias("_l"), F.regr_slope(value, z).alias("_a"), F.regr_intercept(value, z).alias("_b"))
    t = test.join(last, keys)
    return t.groupBy(*keys).agg(F.avg(F.abs(F.col(value) - F.col("_l")[value])).alias("hold"), F.avg(F.abs(F.col(value) - F.col("_a") * F.col(z) - F.col("_b"))).alias("line"))


def coverage_by_ring(cells: DataFrame, keys: list[str], r: Column, on: Column, width: float) -> DataFrame:
    """Share of a mask on each ring: keys, ring, share, n."""
    return cells.groupBy(*keys, F.floor(r / width).cast("int").alias("ring")).agg(F.avg(on.cast("int")).alias("share"), F.count("*").alias("n"))


def edge_scatter(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Robust scatter of a series and of its step to step change: keys, scatter, jitter."""
    w = ordered(keys, order)
    steps = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    a = aggregates.robust_scatter(df, keys, value).select(*keys, "scatter")
    b = aggregates.robust_scatter(steps.where("_d IS NOT NULL"), keys, "_d").select(*keys, F.col("scatter").alias("jitter"))
    return a.join(b, keys, "left")


def class_shares(df: DataFrame, keys: list[str], label: str, classes: list[int]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg((F.col(label) == c).cast("int")).alias(f"class_{c}") for c in classes], F.count("*").alias("n"))


def consensus_outermost(runs: DataFrame, keys: list[str], r: str, group: list[str]) -> DataFrame:
    """Of rays with more runs than the group's 90th percentile only the outermost that many."""
    n = runs.groupBy(*group, *keys).agg(F.count("*").alias("_n"))
    top = n.groupBy(*group).agg(F.floor(F.percentile("_n", F.lit(0.9))).cast("int").alias("_top"))
    rank = F.row_number().over(ordered([*group, *keys], F.desc(r)))
    return runs.join(top, group).withColumn("_k", rank).where("_k <= _top").drop("_k", "_top")


def normal_profile_fit(cells: DataFrame, keys: list[str], pred: str, truth: str) -> DataFrame:
    """Error, correlation and share of exact labels in one pass: keys, rmse, mae, corr."""
    d = F.col(pred) - F.col(truth)
    return cells.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.corr(pred, truth).alias("corr"))


def nested_fit_residuals(df: DataFrame, keys: list[str], row: str, along: str, value: str) -> DataFrame:
    """Median absolute residual of a field under a line along it, and under a free offset for each
    row on top: keys, line, free."""
    fit = aggregates.line_fit(df, keys, along, value).select(*keys, "slope", "intercept")
    r = df.join(fit, keys).withColumn("_r", F.col(value) - F.col("slope") * F.col(along) - F.col("intercept"))
    off = r.groupBy(*keys, row).agg(F.avg("_r").alias("_o"))
    r = r.join(off, [*keys, row])
    return r.groupBy(*keys).agg(median(F.abs("_r")).alias("line"), median(F.abs(F.col("_r") - F.col("_o"))).alias("free"))


def weighted_centroid(df: DataFrame, keys: list[str], at: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(ratio(F.sum(F.col(at) * F.col(weight)), F.sum(weight)).alias("centroid"))


def baseline_centroid(df: DataFrame, keys: list[str], at: str, value: str, share: float = 0.1) -> DataFrame:
    """The centroid of what a profile rises over a low percentile."""
    base = df.groupBy(*keys).agg(F.percentile(value, F.lit(share)).alias("_b"))
    up = F.greatest(F.col(value) - F.col("_b"), F.lit(0.0))
    return weighted_centroid(df.join(base, keys).withColumn("_w", up), keys, at, "_w")


def equalise(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Adds equalised: the cumulative share of the value's histogram bin."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    j = df.join(span, keys)
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).cast("int")
    j = j.withColumn("_bin", b)
    h = j.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    up = F.sum("_n").over(ordered(keys, "_bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_n").over(Window.partitionBy(*keys))
    return j.join(h.withColumn("equalised", up).drop("_n"), [*keys, "_bin"]).drop("_bin", "_lo", "_hi")


def smooth_bins(df: DataFrame, keys: list[str], at: str, value: str, bins: int) -> DataFrame:
    """Median value in equal-width bins of a place, with the bin's middle, and the deviation inside."""
    b = histogram_bin(F.col(at), 0.0, TWO_PI, bins)
    return df.groupBy(*keys, b.alias("bin")).agg(median(F.col(value)).alias("r"), F.count("*").alias("n")).where("bin IS NOT NULL")


def clipped_to_skeleton(df: DataFrame, value: str, skeleton: str, reach: float = 11.0) -> DataFrame:
    return df.withColumn(value, F.least(F.greatest(F.col(value), F.col(skeleton) - reach), F.col(skeleton) + reach))


def mad_gate(df: DataFrame, keys: list[str], value: str, limit: float) -> DataFrame:
    """Rows within ``limit`` scaled MADs of their key's median."""
    m = df.groupBy(*keys).agg(median(F.col(value)).alias("_m"))
    d = df.join(m, keys)
    s = d.groupBy(*keys).agg((MAD_SCALE * median(F.abs(F.col(value) - F.col("_m")))).alias("_s"))
    return d.join(s, keys).where(F.abs(F.col(value) - F.col("_m")) <= limit * F.col("_s")).drop("_m", "_s")


def fixed_scale(v: Column, lo: float, hi: float) -> Column:
    return rint(clip((v - lo) / (hi - lo), 0.0, 1.0) * 255).cast("int")


def strip_from_knots(places: DataFrame, knots: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    return interp.interpolate(places, knots, keys, at, value)
