"""Interpolation and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.semantics import lerp, ordered, rint
from lamina.operators.matching import asof


def interpolate(queries: DataFrame, knots: DataFrame, keys: list[str], at: str, value: str, outside: str = "hold") -> DataFrame:
    """Piecewise linear values of ``knots`` at the queries' places; outside the knots the end
    values hold, or NULL with outside="null". Knots are distinct in (keys, at)."""
    back = asof(queries, knots, keys, at, [value]).withColumnsRenamed({value: "_v0", f"{at}_right": "_t0"})
    both = asof(back, knots, keys, at, [value], forward=True).withColumnsRenamed({value: "_v1", f"{at}_right": "_t1"})
    inside = F.when(F.col("_t1") == F.col("_t0"), F.col("_v0")).otherwise(lerp(F.col("_v0"), F.col("_v1"), (F.col(at) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))))
    held = F.coalesce(inside, F.col("_v0"), F.col("_v1")) if outside == "hold" else inside
    return both.withColumn(value, held).drop("_v0", "_v1", "_t0", "_t1")


def extend_line(queries: DataFrame, knots: DataFrame, keys: list[str], at: str, value: str, span: float, least: int = 3) -> DataFrame:
    """interpolate() inside the knots; outside, the least-squares line of the knots within ``span``
    of the end, or the end value where fewer than ``least`` are there. Adds origin: inside,
    line or hold."""
    ends = knots.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    k = knots.join(ends, keys)
    fit = lambda near, s: k.where(near).groupBy(*keys).agg(F.regr_slope(value, at).alias(f"_a{s}"), F.regr_intercept(value, at).alias(f"_b{s}"), F.count("*").alias(f"_n{s}"))
    low, high = fit(F.col(at) <= F.col("_lo") + span, "l"), fit(F.col(at) >= F.col("_hi") - span, "h")
    q = interpolate(queries, knots, keys, at, value).join(ends, keys, "left").join(low, keys, "left").join(high, keys, "left")
    below, above = F.col(at) < F.col("_lo"), F.col(at) > F.col("_hi")
    use_low, use_high = below & (F.col("_nl") >= least) & F.col("_al").isNotNull(), above & (F.col("_nh") >= least) & F.col("_ah").isNotNull()
    out = F.when(use_low, F.col("_al") * F.col(at) + F.col("_bl")).when(use_high, F.col("_ah") * F.col(at) + F.col("_bh")).otherwise(F.col(value))
    origin = F.when(use_low | use_high, "line").when(below | above, "hold").otherwise("inside")
    return q.withColumns({value: out, "origin": origin}).drop("_lo", "_hi", "_al", "_bl", "_nl", "_ah", "_bh", "_nh")


def circular_interpolate(queries: DataFrame, knots: DataFrame, keys: list[str], at: str, value: str, period: float) -> DataFrame:
    """interpolate() on a circle: knots repeated one turn before and after."""
    turns = F.explode(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0)))
    k = knots.withColumn("_turn", turns).withColumn(at, F.col(at) + F.col("_turn") * period).drop("_turn")
    return interpolate(queries, k, keys, at, value)


def resample_index(df: DataFrame, keys: list[str], index: str, value: str, n_out: int) -> DataFrame:
    """A series of 0-based indices resampled linearly to ``n_out`` evenly spread places. Each row makes
    the places from its index to the next, so a key is shuffled once and nothing is joined."""
    known = df.where(F.col(index).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    rows = known.select(*keys, F.col(index).alias("_x"), F.col(index).cast("long").alias("_i"), F.col(value).alias("_a"))
    near = ordered(keys, "_i")
    after = F.collect_list(F.struct(F.col("_a").alias("_b"))).over(near.rangeBetween(1, 1))
    rows = rows.withColumns({"_n": F.max("_x").over(near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 1, "_next": after})
    step = lambda c: F.lit(0.0) if n_out == 1 else c * (F.col("_n") - 1) / (n_out - 1)
    last = F.greatest(F.col("_n") - 2, F.lit(0)).cast("long")
    # one place more at either end, for rounding; the filter decides
    per = (n_out - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    lo = F.greatest(F.floor(F.col("_i") * per) - 1, F.lit(0)).cast("int")
    hi = F.when(F.col("_i") >= last, F.lit(n_out - 1)).otherwise(F.least(F.ceil((F.col("_i") + 1) * per) + 1, F.lit(n_out - 1)).cast("int"))
    own = lambda c: F.least(F.floor(step(c)), last) == F.col("_i")
    places = rows.where(F.col("_i").between(F.lit(0), last) & (lo <= hi)).withColumn("col", F.explode(F.filter(F.sequence(lo, hi), own)))
    both = places.select(*keys, "col", "_i", "_n", "_a", F.explode_outer("_next").alias("_next"))
    return both.select(*keys, "col", lerp(F.col("_a"), F.coalesce("_next._b", "_a"), step(F.col("col")) - F.col("_i")).alias(value))


def resample_nearest(df: DataFrame, keys: list[str], index: str, n_out: int) -> DataFrame:
    """Rows picked at the nearest of ``n_out`` evenly spread indices; a row may repeat."""
    n = df.groupBy(*keys).agg((F.max(index) + 1).alias("_n"))
    step = F.lit(0) if n_out == 1 else rint(F.col("col") * (F.col("_n") - 1) / (n_out - 1)).cast("long")
    places = n.select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(n_out - 1))).alias("col")).withColumn(index, step).drop("_n")
    return places.join(df.withColumn(index, F.col(index).cast("long")), [*keys, index])


def arc_columns(points: DataFrame, keys: list[str], s: str, phi: str, px: float) -> DataFrame:
    """Places at even arc length along curves: for each column of ``px`` the azimuth."""
    length = points.groupBy(*keys).agg(F.max(s).alias("_len"))
    n = F.greatest(rint(F.col("_len") / px).cast("int"), F.lit(1))
    cols = length.select(*keys, F.explode(F.sequence(F.lit(0), n)).alias("col"), (F.col("_len") / n).alias("_step")).withColumn(s, F.col("col") * F.col("_step")).drop("_step")
    return interpolate(cols, points.select(*keys, s, phi), keys, s, phi)


def histogram_match(source: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Source values mapped so that their distribution is the reference's: adds matched. Both
    cumulative shares are of distinct values; the reference is read by interpolation."""

    def cdf(df: DataFrame) -> DataFrame:
        n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
        c = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c")).join(n, keys)
        up = F.sum("c").over(ordered(keys, "v").rowsBetween(Window.unboundedPreceding, 0))
        return c.select(*keys, "v", (up / F.col("_n")).alias("q"))

    mapped = interpolate(cdf(source), cdf(reference).select(*keys, "q", F.col("v").alias("matched")), keys, "q", "matched")
    return source.join(mapped.select(*keys, F.col("v").alias(value), "matched"), [*keys, value])


def z_fill(df: DataFrame, keys: list[str], z: str, value: Column, name: str) -> DataFrame:
    """Missing values copied from the nearest row in z, the lower one on ties; origin tells."""
    w = ordered(keys, z)
    here = F.when(value.isNotNull(), F.struct(F.col(z).alias("z"), value.alias("v")))
    below, above = F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = df.withColumns({"_b": below, "_a": above})
    lower = F.coalesce(F.col(z) - F.col("_b.z") <= F.col("_a.z") - F.col(z), F.col("_b").isNotNull())
    return rows.withColumns({name: F.when(lower, F.col("_b.v")).otherwise(F.col("_a.v")), "origin": F.when(value.isNotNull(), "walked").otherwise("copied")}).drop("_a", "_b")


def blend(a: DataFrame, b: DataFrame, on: list[str], value: str, weight: float) -> DataFrame:
    """(1 - weight) a + weight b where both have the key; origin is blended."""
    other = b.select(*on, F.col(value).alias("_o"))
    return a.join(other, on).withColumns({value: F.col(value) * (1 - weight) + F.col("_o") * weight, "origin": F.lit("blended")}).drop("_o")


def bilinear(points: DataFrame, pixels: DataFrame, keys: list[str], x: str, y: str, value: str) -> DataFrame:
    """Values of a raster in long form (keys, row, col, value) between four pixels; outside it 0.
    An equi-join on the pixels around each different place, and one back to the points; points at
    one place have one value. A place with a null coordinate has a null value."""
    place = [*keys, x, y]
    p = points.select(*place).distinct().withColumns({"_c": F.floor(x).cast("int"), "_r": F.floor(y).cast("int")})
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in (0, 1) for j in (0, 1)]))
    p = p.withColumn("_k", corners).withColumns({"row": F.col("_r") + F.col("_k.dr"), "col": F.col("_c") + F.col("_k.dc")})
    weight = (1 - F.abs(F.col(x) - F.col("col"))) * (1 - F.abs(F.col(y) - F.col("row")))
    near = p.join(pixels.select(*keys, "row", "col", F.col(value).alias("_v")), [*keys, "row", "col"], "left")
    return points.join(near.groupBy(*place).agg(F.sum(F.coalesce("_v", F.lit(0.0)) * weight).alias(value)), place, "left").select(*points.columns, value)


def taps(points: DataFrame, x: str, y: str, nx: str, ny: str, n: int, spacing: float) -> DataFrame:
    """``n`` points spread evenly along each point's normal."""
    offsets = [(k - (n - 1) / 2) * spacing for k in range(n)]
    t = points.withColumn("tap", F.explode(F.array(*map(F.lit, offsets))))
    return t.withColumns({x: F.col(x) + F.col("tap") * F.col(nx), y: F.col(y) + F.col("tap") * F.col(ny)})
