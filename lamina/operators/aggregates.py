"""Aggregations: scoring, scatter, statistics of images and series."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.semantics import MAD_SCALE, centred, circular_mean, finite, histogram_bin, median, ordered, ratio, rint, running, wrap_angle
from lamina.operators.rounds import exact_quantiles


def confusion(df: DataFrame, keys: list[str], predicted: str, truth: str, classes: list[int]) -> DataFrame:
    """tp, fp, fn per key and class, from one pass."""
    c = F.explode(F.array(*map(F.lit, classes))).alias("cls")
    counts = df.groupBy(*keys, predicted, truth).agg(F.count("*").alias("n")).select("*", c)
    p, t = F.col(predicted) == F.col("cls"), F.col(truth) == F.col("cls")
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).cast("long")
    return counts.groupBy(*keys, "cls").agg(total(p & t).alias("tp"), total(p & ~F.coalesce(t, F.lit(False))).alias("fp"), total(t & ~F.coalesce(p, F.lit(False))).alias("fn"))


def scores(counts: DataFrame) -> DataFrame:
    """Dice, IoU, precision and recall; NULL on 0 / 0."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.withColumns({"dice": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})


def _reserve(f):
    """Key columns get reserved names inside an operator, so that none meets a working column."""

    @functools.wraps(f)
    def run(df, keys, *args, **more):
        names = {k: f"__key_{n}" for n, k in enumerate(keys)}
        out = f(df.withColumnsRenamed(names), list(names.values()), *args, **more)
        return out.withColumnsRenamed({v: k for k, v in names.items()})

    return run


METRICS = ("dice", "iou", "precision", "recall")


def macro(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over cases by class, NULLs left out, then over classes."""
    by_class = scored.groupBy(*keys, "cls").agg(*[F.avg(m).alias(m) for m in METRICS])
    return by_class.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in METRICS])


def mean_nonfinite_as_zero(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Means in which a missing or infinite value counts as 0."""
    return df.groupBy(*keys).agg(*[F.avg(F.coalesce(finite(F.col(c)), F.lit(0.0))).alias(c) for c in columns])


@_reserve
def metric_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long form: key, metric, mean, median and n over finite values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), finite(F.col(m)).alias("v")) for m in metrics]))
    rows = df.select(*keys, pairs.alias("x")).select(*keys, "x.metric", "x.v").where("v IS NOT NULL")
    return rows.groupBy(*keys, "metric").agg(F.avg("v").alias("mean"), median(F.col("v")).alias("median"), F.count("*").alias("n"))


def scatter_mean(df: DataFrame, row: Column, col: Column, value: Column) -> DataFrame:
    """Mean and count of the values that fall on each cell."""
    return df.select(row.alias("row"), col.alias("col"), value.alias("v")).groupBy("row", "col").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def scatter_label(df: DataFrame, row: Column, col: Column, value: Column, label: Column) -> DataFrame:
    """Mean value and rounded mean label of each cell."""
    return df.select(row.alias("row"), col.alias("col"), value.alias("v"), label.alias("l")).groupBy("row", "col").agg(F.avg("v").alias("mean"), rint(F.avg("l")).cast("int").alias("label"))


def densify(cells: DataFrame, rows: int, cols: int, value: str, fill: float = 0.0) -> DataFrame:
    """Every cell of a grid, missing ones filled."""
    grid = cells.sparkSession.range(rows * cols).select((F.col("id") / cols).cast("long").alias("row"), F.pmod("id", F.lit(cols)).alias("col"))
    return grid.join(cells, ["row", "col"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def centroid(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count("*").alias("n"))


def trimmed_circular_mean(df: DataFrame, keys: list[str], angle: str, limit_deg: float = 30.0) -> DataFrame:
    """The circular mean, and that of the angles at most ``limit_deg`` from it."""
    first = df.groupBy(*keys).agg(circular_mean(F.col(angle)).alias("rough"))
    near = df.join(first, keys).where(F.abs(wrap_angle(F.col(angle) - F.col("rough"))) <= math.radians(limit_deg))
    return near.groupBy(*keys).agg(F.first("rough").alias("rough"), circular_mean(F.col(angle)).alias("mean"), F.count("*").alias("n"))


@_reserve
def otsu(df: DataFrame, keys: list[str], value: str, bins: int = 512) -> DataFrame:
    """The threshold of the largest between-class variance on a histogram of the value's range."""
    span = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    hist = df.join(span, keys).groupBy(*keys, "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"))
    hist = hist.withColumn("c", F.col("lo") + (F.col("bin") + 0.5) * width)
    w = running(keys, "bin")
    total = ordered(keys, "bin").rowsBetween(-bins, bins)
    hist = hist.withColumns({"w0": F.sum("n").over(w).cast("double"), "s0": F.sum(F.col("n") * F.col("c")).over(w), "wt": F.sum("n").over(total).cast("double"), "st": F.sum(F.col("n") * F.col("c")).over(total)})
    w1 = F.col("wt") - F.col("w0")
    gap = F.try_divide(F.col("s0"), F.col("w0")) - F.try_divide(F.col("st") - F.col("s0"), w1)
    hist = hist.withColumn("between", F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(-1.0)))
    best = hist.withColumn("_n", F.row_number().over(ordered(keys, F.desc("between"), "bin"))).where("_n = 1")
    return best.select(*keys, F.col("c").alias("threshold"), "bin")


def entropy_of(n: Column, total: Column) -> Column:
    p = n / total
    return -F.sum(p * F.ln(p))


@_reserve
def mutual_information(df: DataFrame, keys: list[str], a: str, b: str, bins: int = 64, span: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Normalised mutual information (H(a) + H(b)) / H(a, b) of a joint histogram."""
    cells = df.select(*keys, histogram_bin(F.col(a), *span, bins).alias("i"), histogram_bin(F.col(b), *span, bins).alias("j")).where("i IS NOT NULL AND j IS NOT NULL")
    joint = cells.groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))
    total = joint.groupBy(*keys).agg(F.sum("n").alias("t"))
    h = lambda by, name: joint.groupBy(*keys, *by).agg(F.sum("n").alias("n")).join(total, keys).groupBy(*keys).agg(entropy_of(F.col("n"), F.col("t")).alias(name))
    parts = h(["i"], "ha").join(h(["j"], "hb"), keys).join(h(["i", "j"], "hab"), keys)
    return parts.select(*keys, F.try_divide(F.col("ha") + F.col("hb"), F.col("hab")).alias("nmi"))


def pair_errors(df: DataFrame, keys: list[str], a: str, b: str, top: float = 1.0) -> DataFrame:
    """mse, rmse, mae and psnr of two columns; the psnr of equal ones is infinite."""
    d = F.col(a) - F.col(b)
    e = df.groupBy(*keys).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))
    return e.select(*keys, "mse", F.sqrt("mse").alias("rmse"), "mae", psnr_of(F.col("mse"), top).alias("psnr"))


def psnr_of(mse: Column, top: float = 1.0) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(top * top) / mse))


def psnr_two_ways(errors: DataFrame, keys: list[str], top: float = 1.0) -> DataFrame:
    """Of per-pair errors: the mean of their psnr, and the psnr of their mean error."""
    return errors.groupBy(*keys).agg(F.avg(psnr_of(F.col("mse"), top)).alias("mean_psnr"), psnr_of(F.avg("mse"), top).alias("psnr_of_mean"))


@_reserve
def weighted_correlation(df: DataFrame, keys: list[str], a: str, b: str, w: str) -> DataFrame:
    """Weighted Pearson correlation; 0 where a variance vanishes."""
    x, y, k = F.col(a), F.col(b), F.col(w)
    s = df.groupBy(*keys).agg(F.sum(k).alias("w"), F.sum(k * x).alias("x"), F.sum(k * y).alias("y"), F.sum(k * x * x).alias("xx"), F.sum(k * y * y).alias("yy"), F.sum(k * x * y).alias("xy"))
    mx, my = ratio(F.col("x"), F.col("w")), ratio(F.col("y"), F.col("w"))
    cov = ratio(F.col("xy"), F.col("w")) - mx * my
    vx, vy = ratio(F.col("xx"), F.col("w")) - mx * mx, ratio(F.col("yy"), F.col("w")) - my * my
    return s.select(*keys, F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy)).otherwise(0.0).alias("corr"))


def row_coherence(df: DataFrame, row: str, values: str) -> DataFrame:
    """Pearson correlation of each array row with the next one."""
    nxt = df.select((F.col(row) - 1).alias(row), F.col(values).alias("_next"))
    pairs = df.select(row, values).join(nxt, row)
    x = pairs.select(row, F.explode(F.arrays_zip(F.col(values).alias("a"), F.col("_next").alias("b"))).alias("p"))
    return x.groupBy(row).agg(F.corr(F.col("p.a").cast("double"), F.col("p.b").cast("double")).alias("corr"))


def strip_scores(df: DataFrame, row: str, values: str) -> DataFrame:
    """One row of quality scores of a strip of array rows: coherence, p5 to p95, mean row variance,
    share of finite and non-zero samples. The percentiles come from histograms that narrow, so no
    task sees all samples; NaN and NULL are left out of them. A strip without samples scores NULL."""
    cells = df.select(row, F.explode(values).alias("v")).select(row, F.col("v").cast("double").alias("v"))
    low, high = exact_quantiles(cells, "v", [0.05, 0.95])
    flat = cells.agg(F.avg(((F.col("v") != 0) & finite(F.col("v")).isNotNull()).cast("int")).alias("filled")).withColumn("dynamic_range", F.lit(None if low is None else high - low).cast("double"))
    var = cells.groupBy(row).agg(F.var_pop("v").alias("x")).agg(F.avg("x").alias("row_var_mean"))
    coh = row_coherence(df, row, values).agg(F.avg("corr").alias("z_coherence"))
    return flat.join(F.broadcast(var)).join(F.broadcast(coh))  # one row each


@_reserve
def robust_scatter(df: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """The scaled MAD about the median; NULL for fewer than ``least`` values."""
    m = df.groupBy(*keys).agg(median(F.col(value)).alias("_m"), F.count(value).alias("n"))
    s = df.join(m, keys).groupBy(*keys).agg((MAD_SCALE * median(F.abs(F.col(value) - F.col("_m")))).alias("_s"), F.first("n").alias("n"))
    return s.select(*keys, F.when(F.col("n") >= least, F.col("_s")).alias("scatter"), "n")


def line_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, slope, intercept, n of the least-squares line; rows with a NULL in x or y don't count. NULL where all
    x are equal or none is left; NaN goes through."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def clipped_line(df: DataFrame, keys: list[str], x: str, y: str, rounds: int = 4, limit: float = 2.5, floor: float = 0.0) -> DataFrame:
    """A least-squares line refitted to the points within ``limit`` scaled MADs of the last one
    (``floor`` at least): every row with fit, residual and used."""
    whole = Window.partitionBy(*keys)
    rows = _against_line(df.withColumn("used", F.lit(True)), whole, x, y)
    for _ in range(rounds):
        scale = MAD_SCALE * median(F.when(F.col("used"), F.abs("residual"))).over(whole)
        rows = rows.withColumn("_s", scale).withColumn("used", F.abs("residual") <= F.greatest(limit * F.col("_s"), F.lit(floor))).drop("_s", "fit", "residual")
        rows = _against_line(rows, whole, x, y)
    return rows


def _against_line(rows: DataFrame, whole, x: str, y: str) -> DataFrame:
    used = lambda c: F.when(F.col("used"), F.col(c))
    rows = rows.withColumns({"_a": F.regr_slope(used(y), used(x)).over(whole), "_b": F.regr_intercept(used(y), used(x)).over(whole)})
    return rows.withColumn("fit", F.col("_a") * F.col(x) + F.col("_b")).withColumn("residual", F.col(y) - F.col("fit")).drop("_a", "_b")


@_reserve
def circle_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Algebraic circle: centre and radius by normal equations about the mean."""
    m = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    c = df.join(m, keys).withColumns({"_u": F.col(x) - F.col("_mx"), "_v": F.col(y) - F.col("_my")})
    u, v = F.col("_u"), F.col("_v")
    z = u * u + v * v
    s = c.groupBy(*keys).agg(F.first("_mx").alias("mx"), F.first("_my").alias("my"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"), F.sum(u * z).alias("uz"), F.sum(v * z).alias("vz"), F.avg(z).alias("z"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    a = F.try_divide(F.col("uz") * F.col("vv") - F.col("vz") * F.col("uv"), 2 * det)
    b = F.try_divide(F.col("vz") * F.col("uu") - F.col("uz") * F.col("uv"), 2 * det)
    return s.select(*keys, (F.col("mx") + a).alias("cx"), (F.col("my") + b).alias("cy"), F.sqrt(a * a + b * b + F.col("z")).alias("r"))


def phase_fold(df: DataFrame, keys: list[str], index: str, value: str, period: float, bins: int) -> DataFrame:
    """Mean value by phase bin, and which bin is darkest (the first on ties)."""
    b = F.floor(F.pmod(F.col(index).cast("double"), F.lit(float(period))) / period * bins).cast("int")
    folded = df.groupBy(*keys, b.alias("phase")).agg(F.avg(value).alias("mean"))
    return folded.withColumn("rank", F.row_number().over(ordered(keys, "mean", "phase")))


def best_phase(df: DataFrame, keys: list[str], index: str, value: str, pitch: int) -> DataFrame:
    """The offset 0 .. pitch - 1 at which every pitch-th sample is largest on average."""
    s = df.groupBy(*keys, F.pmod(F.col(index), F.lit(pitch)).alias("offset")).agg(F.avg(value).alias("mean"))
    return s.withColumn("_n", F.row_number().over(ordered(keys, F.desc("mean"), "offset"))).where("_n = 1").drop("_n")


def block_ratio(df: DataFrame, row: str, col: str, value: str, rows: int, cols: int, half: int = 4) -> DataFrame:
    """Block means over the median of the blocks around them in their column of blocks."""
    b = df.groupBy(F.floor(F.col(row) / rows).alias("br"), F.floor(F.col(col) / cols).alias("bc")).agg(F.avg(value).alias("mean"))
    return b.withColumn("ratio", F.try_divide(F.col("mean"), median(F.col("mean")).over(centred(["bc"], half, "br"))))


@_reserve
def polynomial_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Quadratic least squares by normal equations: c0 + c1 x + c2 x^2 about the mean of x."""
    m = df.groupBy(*keys).agg(F.avg(x).alias("_mx"))
    d = df.join(m, keys).withColumn("_d", F.col(x) - F.col("_mx"))
    p = lambda k: F.pow("_d", F.lit(k))
    s = d.groupBy(*keys).agg(F.first("_mx").alias("x0"), F.count("*").cast("double").alias("n"), *[F.sum(p(k)).alias(f"s{k}") for k in (1, 2, 3, 4)], *[F.sum(p(k) * F.col(y)).alias(f"t{k}") for k in (0, 1, 2)])
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det3 = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    det = det3(n, s1, s2, s1, s2, s3, s2, s3, s4)
    c0, c1, c2 = det3(t0, s1, s2, t1, s2, s3, t2, s3, s4), det3(n, t0, s2, s1, t1, s3, s2, t2, s4), det3(n, s1, t0, s1, s2, t1, s2, s3, t2)
    return s.select(*keys, "x0", *[F.try_divide(c, det).alias(f"c{k}") for k, c in enumerate((c0, c1, c2))])
