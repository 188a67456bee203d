"""Operators over rows in an order: runs, gaps, healing, indexing, arc length.

Every operator takes partition columns, so that no window meets all rows in one task unless the
data is one series; ``order`` must be total within a partition for results to be reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.semantics import MAD_SCALE, centred, lerp, median, ordered, rint, running

_PAST, _AHEAD = Window.unboundedPreceding, Window.unboundedFollowing


def runs(df: DataFrame, keys: list[str], pos: str, on: Column, min_length: float = 0, count_samples: bool = False) -> DataFrame:
    """Maximal stretches of consecutive rows where ``on`` holds: keys, run_no (from 0), lo, hi, n.
    Length is hi - lo, or the number of samples."""
    marked = df.select(*keys, F.col(pos).alias("_p"), F.coalesce(on, F.lit(False)).alias("_on"))
    marked = marked.withColumn("_first", (F.col("_on") & ~F.coalesce(F.lag("_on").over(ordered(keys, "_p")), F.lit(False))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_first").over(running(keys, "_p"))).where("_on")
    out = marked.groupBy(*keys, "_run").agg(F.min("_p").alias("lo"), F.max("_p").alias("hi"), F.count("*").alias("n"))
    length = F.col("n") if count_samples else F.col("hi") - F.col("lo")
    out = out.where(length >= min_length)
    return out.withColumn("run_no", F.row_number().over(ordered(keys, "lo")) - 1).select(*keys, "run_no", "lo", "hi", "n")


def circular_runs(df: DataFrame, keys: list[str], pos: str, on: Column, period: int) -> DataFrame:
    """runs() on a circle of ``period`` positions: a run that reaches the end continues at 0."""
    flat = runs(df, keys, pos, on)
    first = flat.where("lo = 0").select(*keys, F.col("hi").alias("_wrap"), F.col("n").alias("_more"))
    w = flat.join(first, keys, "left")
    ends = F.col("hi") == period - 1
    whole = F.col("lo") == 0
    joined = ends & F.col("_wrap").isNotNull() & ~whole
    w = w.withColumns({"n": F.when(joined, F.col("n") + F.col("_more")).otherwise(F.col("n")), "hi": F.when(joined, F.col("_wrap") + period).otherwise(F.col("hi"))})
    has_end = flat.where(F.col("hi") == period - 1).where("lo > 0").select(*keys, F.lit(True).alias("_tail"))
    w = w.join(has_end, keys, "left").where(~(whole & F.col("_tail").isNotNull()))
    return w.withColumn("run_no", F.row_number().over(ordered(keys, "lo")) - 1).select(*keys, "run_no", "lo", "hi", "n")


def run_midpoints(run_table: DataFrame) -> DataFrame:
    return run_table.withColumn("mid", (F.col("lo") + F.col("hi")) / 2)


def kth_run_profile(run_table: DataFrame, group: list[str], ray: str) -> DataFrame:
    """Rays of a group vote for the number of runs (the mode, the smallest on ties); the k-th run's
    median centre over the rays that have that many."""
    per_ray = run_table.groupBy(*group, ray).agg(F.count("*").alias("runs"))
    votes = per_ray.groupBy(*group, "runs").agg(F.count("*").alias("rays"))
    mode = votes.groupBy(*group).agg(F.max(F.struct("rays", (-F.col("runs")).alias("fewer"))).alias("m")).select(*group, (-F.col("m.fewer")).alias("runs"))
    whole = run_midpoints(run_table).join(per_ray, [*group, ray]).join(mode, [*group, "runs"])
    return whole.groupBy(*group, F.col("run_no").alias("k")).agg(median(F.col("mid")).alias("r"), F.count("*").alias("rays"))


def infill_spacing(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Evenly spaced rows put into gaps that hold several median spacings: keys, pos, filled."""
    gaps = df.select(*keys, F.col(pos).cast("double").alias("_p")).withColumn("_next", F.lead("_p").over(ordered(keys, "_p")))
    med = gaps.groupBy(*keys).agg(median(F.col("_next") - F.col("_p")).alias("_med"))
    return _fill(gaps.join(med, keys), keys, F.col("_med"), None, pos)


def infill_spacing_local(df: DataFrame, keys: list[str], pos: str, window: int = 4, max_fill: int = 3) -> DataFrame:
    """The same with the median of the ``window`` gaps on either side, the gap itself left out; a
    gap that would take more than ``max_fill`` rows is a void and stays empty."""
    gaps = df.select(*keys, F.col(pos).cast("double").alias("_p")).withColumn("_next", F.lead("_p").over(ordered(keys, "_p")))
    gaps = gaps.withColumn("_gap", F.col("_next") - F.col("_p"))
    near = ordered(keys, "_p")
    around = F.concat(F.collect_list("_gap").over(near.rowsBetween(-window, -1)), F.collect_list("_gap").over(near.rowsBetween(1, window)))
    s = F.array_sort(F.filter(around, lambda x: x.isNotNull()))
    n = F.size(s)
    mid = (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2
    return _fill(gaps.withColumn("_med", F.when(n > 0, mid)), keys, F.col("_med"), max_fill, pos)


def _fill(gaps: DataFrame, keys: list[str], med: Column, max_fill: int | None, pos: str) -> DataFrame:
    extra = F.greatest(F.coalesce(rint(F.try_divide(F.col("_next") - F.col("_p"), med)).cast("int") - 1, F.lit(0)), F.lit(0))
    if max_fill is not None:
        extra = F.when(extra > max_fill, 0).otherwise(extra)
    rows = gaps.withColumn("_k", extra).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    at = F.when(F.col("_i") == 0, F.col("_p")).otherwise(lerp(F.col("_p"), F.col("_next"), F.col("_i") / (F.col("_k") + 1)))
    return rows.select(*keys, at.alias(pos), (F.col("_i") > 0).alias("filled"))


def midpoints_at_skips(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """A row halfway wherever the index skips exactly one: keys, index, value, filled."""
    w = ordered(keys, index)
    rows = df.select(*keys, index, F.col(value).cast("double").alias(value)).withColumns({"_ni": F.lead(index).over(w), "_nv": F.lead(value).over(w)})
    rows = rows.withColumn("_k", F.explode(F.when(F.col("_ni") - F.col(index) == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(*keys, (F.col(index) + F.col("_k")).alias(index), F.when(F.col("_k") == 0, F.col(value)).otherwise((F.col(value) + F.col("_nv")) / 2).alias(value), (F.col("_k") > 0).alias("filled"))


def heal_outliers(df: DataFrame, keys: list[str], order: str, value: str, half: int = 4, limit: float = 4.0) -> DataFrame:
    """Values further than ``limit`` scaled MADs from the running median of 2 * half + 1 rows are
    replaced by interpolation between their nearest sound neighbours (held at the ends):
    adds med, outlier and healed."""
    rows = df.withColumn("med", median(F.col(value)).over(centred(keys, half, order)))
    scale = rows.groupBy(*keys).agg((F.lit(MAD_SCALE) * median(F.abs(F.col(value) - F.col("med")))).alias("_scale"))
    rows = rows.join(scale, keys)
    rows = rows.withColumn("outlier", F.coalesce(F.abs(F.col(value) - F.col("med")) > limit * F.col("_scale"), F.lit(True))).drop("_scale")
    return fill_between(rows, keys, order, F.when(~F.col("outlier"), F.col(value)), "healed")


def fill_between(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """NULLs of ``value`` interpolated over ``order``; held before the first and after the last."""
    w = ordered(keys, order)
    past, ahead = w.rowsBetween(_PAST, 0), w.rowsBetween(0, _AHEAD)
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col(order).cast("double").alias("t"), F.col("_v").alias("v")))
    rows = df.withColumn("_v", value)
    rows = rows.withColumns({"_a": F.last(known, ignorenulls=True).over(past), "_b": F.first(known, ignorenulls=True).over(ahead)})
    a, b = F.col("_a"), F.col("_b")
    between = F.when(b["t"] == a["t"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col(order).cast("double") - a["t"]) / (b["t"] - a["t"]))
    return rows.withColumn(name, F.coalesce(F.when(a.isNotNull() & b.isNotNull(), between), a["v"], b["v"])).drop("_v", "_a", "_b")


def incremental_index(df: DataFrame, keys: list[str], pos: str, pitch: float) -> DataFrame:
    """A whole-number index that advances by the rounded multiple of the pitch, 1 at least: adds
    idx and the residual to idx * pitch."""
    w = ordered(keys, pos)
    step = F.greatest(F.lit(1.0), rint((F.col(pos) - F.lag(pos).over(w)) / pitch))
    rows = df.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    rows = rows.withColumn("idx", F.sum("_step").over(running(keys, pos)).cast("long")).drop("_step")
    return rows.withColumn("residual", F.col(pos) - F.first(pos).over(running(keys, pos)) - F.col("idx") * pitch)


def unslip(df: DataFrame, keys: list[str], order: str, value: str, pitch: float) -> DataFrame:
    """Whole-pitch jumps between neighbours removed by a running sum: adds unslipped."""
    jump = F.coalesce(rint((F.col(value) - F.lag(value).over(ordered(keys, order))) / pitch), F.lit(0.0))
    rows = df.withColumn("_jump", jump)
    return rows.withColumn("unslipped", F.col(value) - pitch * F.sum("_jump").over(running(keys, order))).drop("_jump")


def leave_one_out(df: DataFrame, keys: list[str], index: str, value: str, half: int = 3, least: int = 3) -> DataFrame:
    """The residual to the line through the neighbours at most ``half`` index steps away, the row
    itself left out; NULL with fewer than ``least``: keys, index, value, residual."""
    me = df.select(*keys, F.col(index).alias("_i"), F.col(value).cast("double").alias("_y"))
    shifts = me.withColumn("_d", F.explode(F.array(*[F.lit(d) for d in range(-half, half + 1) if d])))
    near = shifts.select(*keys, (F.col("_i") + F.col("_d")).alias("_i"), F.col("_d").cast("double").alias("_x"), F.col("_y").alias("_ny"))
    # a neighbour at distance d stands at -d as seen from the row
    sums = near.groupBy(*keys, "_i").agg(F.count("*").alias("_n"), F.sum(-F.col("_x")).alias("_sx"), F.sum("_ny").alias("_sy"), F.sum(F.col("_x") * F.col("_x")).alias("_sxx"), F.sum(-F.col("_x") * F.col("_ny")).alias("_sxy"))
    det = F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    at_zero = F.try_divide(F.col("_sxx") * F.col("_sy") - F.col("_sx") * F.col("_sxy"), det)
    joined = me.join(sums, [*keys, "_i"], "left")
    return joined.select(*keys, F.col("_i").alias(index), F.col("_y").alias(value), F.when(F.col("_n") >= least, F.col("_y") - at_zero).alias("residual"))


def second_difference_noise(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Noise of a series: the scaled MAD of its second differences over the root of 6."""
    w = ordered(keys, order)
    d = df.select(*keys, (F.lag(value).over(w) - 2 * F.col(value) + F.lead(value).over(w)).alias("_d")).where("_d IS NOT NULL")
    mid = d.groupBy(*keys).agg(median(F.col("_d")).alias("_m"))
    return d.join(mid, keys).groupBy(*keys).agg((MAD_SCALE * median(F.abs(F.col("_d") - F.col("_m"))) / F.sqrt(F.lit(6.0))).alias("noise"))


def arc_length(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Adds s, the length of the polyline up to each point."""
    w = ordered(keys, order)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return df.withColumn("_step", step).withColumn("s", F.sum("_step").over(running(keys, order))).drop("_step")


def spiral_arc_table(df: DataFrame, keys: list[str], phi: str, r: str) -> DataFrame:
    """Adds s, the trapezoid sum of sqrt(r^2 + r'^2) over the azimuth; r' is central, one-sided at
    the ends."""
    w = ordered(keys, phi)
    slope = F.coalesce(F.lead(r).over(w), F.col(r)) - F.coalesce(F.lag(r).over(w), F.col(r))
    width = F.coalesce(F.lead(phi).over(w), F.col(phi)) - F.coalesce(F.lag(phi).over(w), F.col(phi))
    rows = df.withColumn("_f", F.sqrt(F.col(r) * F.col(r) + F.pow(F.coalesce(F.try_divide(slope, width), F.lit(0.0)), 2)))
    piece = F.coalesce((F.col("_f") + F.lag("_f").over(w)) / 2 * (F.col(phi) - F.lag(phi).over(w)), F.lit(0.0))
    return rows.withColumn("_d", piece).withColumn("s", F.sum("_d").over(running(keys, phi))).drop("_f", "_d")


def detrend(df: DataFrame, keys: list[str], order: str, value: str, half: int = 1000) -> DataFrame:
    """Adds flat: the value less the mean of 2 * half + 1 rows, the ends repeated as padding, less
    the mean of that."""
    w = centred(keys, half, order)
    n = F.count("*").over(w)
    i = F.row_number().over(ordered(keys, order)) - 1
    size = F.count("*").over(ordered(keys, order).rowsBetween(_PAST, _AHEAD))
    first = F.first(value).over(ordered(keys, order).rowsBetween(_PAST, _AHEAD))
    last = F.last(value).over(ordered(keys, order).rowsBetween(_PAST, _AHEAD))
    low, high = F.greatest(half - i, F.lit(0)), F.greatest(half - (size - 1 - i), F.lit(0))
    rows = df.withColumn("_m", (F.sum(value).over(w) + low * first + high * last) / (n + low + high))
    rows = rows.withColumn("_d", F.col(value) - F.col("_m"))
    means = rows.groupBy(*keys).agg(F.avg("_d").alias("_mean"))
    return rows.join(means, keys).withColumn("flat", F.col("_d") - F.col("_mean")).drop("_m", "_d", "_mean")


def step_response(df: DataFrame, keys: list[str], index: str, value: str, half: int, period: int) -> DataFrame:
    """On a circle of ``period`` samples: the median of ``half`` samples up to each one less that
    of the ``half`` samples after it. Adds step."""
    tripled = df.withColumn("_turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_i", F.col(index) + F.col("_turn") * period)
    w = ordered(keys, "_i")
    m = tripled.withColumn("step", median(F.col(value)).over(w.rowsBetween(-half + 1, 0)) - median(F.col(value)).over(w.rowsBetween(1, half)))
    return m.where("_turn = 0").drop("_turn", "_i")


def circular_mean_filter(df: DataFrame, keys: list[str], index: str, value: str, half: int, period: int) -> DataFrame:
    """Adds smooth: the mean of 2 * half + 1 samples on a circle."""
    tripled = df.withColumn("_turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_i", F.col(index) + F.col("_turn") * period)
    m = tripled.withColumn("smooth", F.avg(value).over(ordered(keys, "_i").rowsBetween(-half, half)))
    return m.where("_turn = 0").drop("_turn", "_i")


def trim_leader(df: DataFrame, keys: list[str], order: str, change: Column, threshold: float) -> DataFrame:
    """Rows from the first one whose ``change`` exceeds the threshold; all, if none does."""
    first = df.where(change > threshold).groupBy(*keys).agg(F.min(order).alias("_from"))
    return df.join(first, keys, "left").where(F.col("_from").isNull() | (F.col(order) >= F.col("_from"))).drop("_from")


def trim_to_active(df: DataFrame, keys: list[str], order: str, active: Column) -> DataFrame:
    """Rows between the first and the last active one; all, if none is."""
    span = df.where(active).groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    return df.join(span, keys, "left").where(F.col("_lo").isNull() | F.col(order).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def clamped_ends(df: DataFrame, keys: list[str], order: str, same_as_next: Column) -> DataFrame:
    """Adds clamped: whether a row belongs to the first or last run of repeated points, where that
    run touches the end of its series."""
    w = ordered(keys, order)
    changes = F.sum((~F.coalesce(same_as_next, F.lit(False))).cast("int"))
    before = changes.over(w.rowsBetween(_PAST, -1))
    after = changes.over(w.rowsBetween(0, _AHEAD))
    alone = F.coalesce(F.lag(F.coalesce(same_as_next, F.lit(False))).over(w), F.lit(False)) | F.coalesce(same_as_next, F.lit(False))
    return df.withColumn("clamped", alone & ((F.coalesce(before, F.lit(0)) == 0) | (F.coalesce(after, F.lit(0)) <= 1)))


def local_extrema(df: DataFrame, keys: list[str], order: str, value: str, min_prominence: float = 0.0) -> DataFrame:
    """Local maxima whose height over the higher of the two minima next to them reaches
    ``min_prominence``: keys, order, value, prominence."""
    w = ordered(keys, order)
    up = F.col(value) > F.coalesce(F.lag(value).over(w), F.lit(float("-inf")))
    down = F.col(value) >= F.coalesce(F.lead(value).over(w), F.lit(float("-inf")))
    low = (F.col(value) <= F.coalesce(F.lag(value).over(w), F.lit(float("inf")))) & (F.col(value) <= F.coalesce(F.lead(value).over(w), F.lit(float("inf"))))
    rows = df.select(*keys, order, value, (up & down).alias("_peak"), F.when(low, F.col(value)).alias("_low"))
    left = F.last("_low", ignorenulls=True).over(w.rowsBetween(_PAST, -1))
    right = F.first("_low", ignorenulls=True).over(w.rowsBetween(1, _AHEAD))
    rows = rows.withColumn("prominence", F.col(value) - F.greatest(left, right)).where("_peak")
    return rows.where(F.coalesce(F.col("prominence"), F.lit(float("inf"))) >= min_prominence).select(*keys, order, value, "prominence")


def level_crossings(df: DataFrame, keys: list[str], order: str, value: str, level: Column) -> DataFrame:
    """The first and last place where a profile crosses a level, between samples: keys, first, last."""
    w = ordered(keys, "_t")
    rows = df.select(*keys, F.col(order).cast("double").alias("_t"), F.col(value).alias("_v"), level.alias("_l")).withColumns({"_pt": F.lag("_t").over(w), "_pv": F.lag("_v").over(w)})
    crossing = ((F.col("_pv") < F.col("_l")) & (F.col("_v") >= F.col("_l"))) | ((F.col("_pv") >= F.col("_l")) & (F.col("_v") < F.col("_l")))
    at = F.col("_pt") + (F.col("_l") - F.col("_pv")) / (F.col("_v") - F.col("_pv")) * (F.col("_t") - F.col("_pt"))
    return rows.where(crossing).groupBy(*keys).agg(F.min(at).alias("first"), F.max(at).alias("last"))


def monotone(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds rail, the running maximum."""
    return df.withColumn("rail", F.max(value).over(running(keys, order)))


def gap_clusters(df: DataFrame, keys: list[str], value: str, max_gap: float) -> DataFrame:
    """Sorted values split at gaps of ``max_gap`` or more: keys, cluster, centre (median), n."""
    w = ordered(keys, value)
    rows = df.select(*keys, value).withColumn("_new", F.coalesce((F.col(value) - F.lag(value).over(w) >= max_gap).cast("int"), F.lit(0)))
    rows = rows.withColumn("cluster", F.sum("_new").over(running(keys, value)))
    return rows.groupBy(*keys, "cluster").agg(median(F.col(value)).alias("centre"), F.count("*").alias("n"))


def cdf_rank(df: DataFrame, keys: list[str], *order, scale: float = 1.0) -> DataFrame:
    """Adds u, the row's rank over the number of rows, times ``scale``."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = df.join(n, keys)
    return rows.withColumn("u", (F.row_number().over(ordered(keys, *order)) - 1) / F.col("_n") * scale).drop("_n")


def difference_from_previous(df: DataFrame, keys: list[str], order: str, pixels: str) -> DataFrame:
    """Adds change: the mean absolute difference of an array to the one before; NULL for the first."""
    before = F.lag(pixels).over(ordered(keys, order))
    total = F.aggregate(F.zip_with(F.col(pixels), before, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("change", total / F.size(pixels))
