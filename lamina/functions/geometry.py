"""Geometry of rasters and curves as expressions: crops, turns, windows, spirals, synthetic patterns."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.semantics import TWO_PI, hashed_uniform, portable_uniform, lerp, ordered, rint


def crop(df: DataFrame, row: str, col: str, height: int, width: int, box: tuple[float, float, float, float]) -> DataFrame:
    """Cells inside a box of shares (top, bottom, left, right), cut off to whole pixels, renumbered from 0."""
    t, b, lo, hi = int(box[0] * height), int(box[1] * height), int(box[2] * width), int(box[3] * width)
    inside = df.where((F.col(row) >= t) & (F.col(row) < b) & (F.col(col) >= lo) & (F.col(col) < hi))
    return inside.withColumns({row: F.col(row) - t, col: F.col(col) - lo})


def crop_interior(df: DataFrame, row: str, col: str, height: int, width: int, share: float) -> DataFrame:
    """Without a margin of a share of each side, rounded half to even."""
    my, mx = round(height * share), round(width * share)
    inside = df.where(F.col(row).between(my, height - my - 1) & F.col(col).between(mx, width - mx - 1))
    return inside.withColumns({row: F.col(row) - my, col: F.col(col) - mx})


def orient(df: DataFrame, row: str, col: str, height: int, width: int, quarter_turns: int = 0, mirror: bool = False) -> DataFrame:
    """Cells after counter-clockwise quarter turns, then a mirror of the columns."""
    r, c, h, w = F.col(row), F.col(col), height, width
    for _ in range(quarter_turns % 4):
        r, c, h, w = (w - 1) - c, r, w, h
    return df.withColumns({row: r, col: (w - 1) - c if mirror else c})


def standardise(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Columns as z-scores, and their (mean, deviation) for the way back."""
    s = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    stats = {c: (s[f"m_{c}"] or 0.0, s[f"s_{c}"] or 1.0) for c in columns}
    return df.withColumns({c: (F.col(c) - m) / (d or 1.0) for c, (m, d) in stats.items()}), stats


def restore(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(c) * (d or 1.0) + m for c, (m, d) in stats.items()})


def scaled_coordinates(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Indices of axes as coordinates in [-1, 1]."""
    return df.withColumns({c: (2.0 * F.col(c) / (n - 1) - 1 if n > 1 else F.lit(0.0)) for c, n in sizes.items()})


def affine_from_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """The affine map (x, y) -> (u, v) of least squares from columns x, y, u, v: keys and the
    coefficients a0 ax ay (of u) and b0 bx by (of v)."""
    m = points.groupBy(*keys).agg(*[F.avg(c).alias(f"_m{c}") for c in "xyuv"])
    d = points.join(m, keys) if keys else points.join(F.broadcast(m))  # one row without keys
    x, y, u, v = (F.col(c) - F.col(f"_m{c}") for c in "xyuv")
    s = d.groupBy(*keys).agg(F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"), F.sum(x * u).alias("xu"), F.sum(y * u).alias("yu"), F.sum(x * v).alias("xv"), F.sum(y * v).alias("yv"), *[F.first(f"_m{c}").alias(f"m{c}") for c in "xyuv"])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    out = {}
    for name, t in (("a", "u"), ("b", "v")):
        out[f"{name}x"] = F.try_divide(F.col(f"x{t}") * F.col("yy") - F.col(f"y{t}") * F.col("xy"), det)
        out[f"{name}y"] = F.try_divide(F.col(f"y{t}") * F.col("xx") - F.col(f"x{t}") * F.col("xy"), det)
        out[f"{name}0"] = F.col(f"m{t}") - out[f"{name}x"] * F.col("mx") - out[f"{name}y"] * F.col("my")
    return s.select(*keys, *[c.alias(n) for n, c in out.items()])


def winding_of(r: Column, phi: Column, r0: float, pitch: float, windings: int) -> Column:
    """The winding whose radius at an azimuth is nearest; the inner one on ties, which are errors equal
    to nine decimals, since rounding in the last bit would decide otherwise."""
    options = F.array(*[F.struct(F.round(F.abs(r - (r0 + pitch * (phi / TWO_PI + k))), 9).alias("error"), F.lit(k).alias("k")) for k in range(windings)])
    return F.array_min(options)["k"]


def normals(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Adds nx and ny, unit normals of a polyline from central differences."""
    w = ordered(keys, order)
    dx = F.coalesce(F.lead(x).over(w), F.col(x)) - F.coalesce(F.lag(x).over(w), F.col(x))
    dy = F.coalesce(F.lead(y).over(w), F.col(y)) - F.coalesce(F.lag(y).over(w), F.col(y))
    rows = df.withColumns({"_dx": dx, "_dy": dy}).withColumn("_n", F.greatest(F.hypot("_dx", "_dy"), F.lit(1e-12)))
    return rows.withColumns({"nx": 0.0 - F.col("_dy") / F.col("_n"), "ny": F.col("_dx") / F.col("_n")}).drop("_dx", "_dy", "_n")


def spiral_cloud(df: DataFrame, k: str, theta: str, seam: float, margin: float) -> DataFrame:
    """(winding, azimuth) as one growing angle phi, without rays within ``margin`` of the seam."""
    a = F.pmod(F.col(theta) - seam, F.lit(TWO_PI))
    return df.where(a.between(margin, TWO_PI - margin)).withColumn("phi", a + F.col(k) * TWO_PI)


def fourier(theta: Column, coefficients: list[float]) -> Column:
    """c0 + a1 cos + b1 sin + a2 cos 2 + ..."""
    total = F.lit(coefficients[0])
    for n, (a, b) in enumerate(zip(coefficients[1::2], coefficients[2::2], strict=True), 1):
        total = total + a * F.cos(n * theta) + b * F.sin(n * theta)
    return total


def patterns(kind: str, x: Column, y: Column, width: int, height: int, seed: int = 0) -> Column:
    """A synthetic strip's value in [0, 1] at column x and row y: gradient, bars, frames or composite."""
    gradient = x / float(max(width - 1, 1))
    bars = (F.pmod(F.floor(x / 16.0), F.lit(2))).cast("double")
    pitch = 64
    k, inside = F.floor(x / float(pitch)), F.pmod(x, F.lit(pitch))
    line = inside < 4
    content = 0.3 + 0.5 * hashed_uniform(k, F.floor(inside / 8.0), F.floor(y / 8.0), seed=seed)
    frames = F.when(line, 0.05).otherwise(content)
    return {"gradient": gradient, "bars": bars, "frames": frames, "composite": (gradient + bars + frames) / 3}[kind]


def windows(df: DataFrame, keys: list[str], values: str, starts: Column, width: int) -> DataFrame:
    """Fixed-width windows of array rows at an array of 0-based starts; those that stick out are left out."""
    rows = df.withColumn("start", F.explode(starts)).where((F.col("start") >= 0) & (F.col("start") + width <= F.size(values)))
    return rows.select(*keys, "start", F.slice(F.col(values), F.col("start") + 1, width).alias("window"))


def hashed_starts(n: int, length: Column, width: int, seed: int, *keys: Column) -> Column:
    """``n`` reproducible window starts for each row."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(portable_uniform(*keys, i, seed=seed) * (length - width + 1)).cast("int"))


def corrupt(window: Column, mode: str, seed: int, *keys: Column) -> Column:
    """A window damaged in a known way: reversed, rolled by a hashed amount, its halves swapped, or
    its values shuffled by hash."""
    n = F.size(window)
    roll = (1 + F.floor(hashed_uniform(*keys, seed=seed) * (n - 1))).cast("int")
    half = (n / 2).cast("int")
    turned = lambda k: F.concat(F.slice(window, k + 1, n - k), F.slice(window, F.lit(1), k))
    shuffled = F.transform(F.array_sort(F.transform(window, lambda v, i: F.struct(F.xxhash64(i, F.lit(seed), *keys).alias("h"), v.alias("v")))), lambda s: s["v"])
    return {"reverse": F.reverse(window), "roll": turned(roll), "swap": turned(half), "shuffle": shuffled}[mode]


def neighbour_change(df: DataFrame, keys: list[str], order: str, pixels: str, least: float) -> DataFrame:
    """Adds motion: for each pixel the larger absolute difference to the frame before and after;
    NULL where no pixel moves by ``least``."""
    w = ordered(keys, order)
    gap = lambda o: F.zip_with(F.col(pixels), o, lambda a, b: F.abs(a - F.coalesce(b, a)))
    before, after = F.coalesce(F.lag(pixels).over(w), F.col(pixels)), F.coalesce(F.lead(pixels).over(w), F.col(pixels))
    rows = df.withColumns({"_b": before, "_a": after}).withColumn("_m", F.zip_with(gap(F.col("_b")), gap(F.col("_a")), lambda p, q: F.greatest(p, q)))
    return rows.withColumn("motion", F.when(F.array_max("_m") >= least, F.col("_m"))).drop("_b", "_a", "_m")


def even_sample(df: DataFrame, index: str, n_in: int, n_out: int) -> DataFrame:
    """Rows at evenly spread indices, one for each output place: adds place."""
    places = df.sparkSession.range(n_out).select(F.col("id").alias("place"), (rint(F.col("id") * (n_in - 1) / max(1, n_out - 1)) if n_out > 1 else F.lit(0.0)).cast("long").alias(index))
    return places.join(df.withColumn(index, F.col(index).cast("long")), index)


def interpolate_grid(a: Column, b: Column, t: Column) -> Column:
    """Two arrays blended element by element."""
    return F.zip_with(a, b, lambda x, y: lerp(x, y, t))


