"""Numeric conventions of array code as Column expressions, stated once.

Missing values are NULL: NaN is turned into NULL on the way in. Rounding is half to even, medians
and percentiles interpolate linearly, ties of arg-max go to the smallest index, remainders are not
negative, standard deviations divide by n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
MAD_SCALE = 1.4826


def number(c: Column) -> Column:
    """A double in which NaN is NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def finite(c: Column) -> Column:
    d = number(c)
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def rint(c: Column) -> Column:
    return F.rint(c.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """NULL on division by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def median(c: Column) -> Column:
    """Also usable over a window frame."""
    return F.percentile(c, F.lit(0.5))


def mad(c: Column, centre: Column) -> Column:
    """Scaled median absolute deviation from a centre that is a column of the same rows."""
    return F.lit(MAD_SCALE) * median(F.abs(c - centre))


def wrap_angle(c: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(c + math.pi, F.lit(TWO_PI)) - math.pi


def turn(c: Column) -> Column:
    """Into [0, 2 pi)."""
    return F.pmod(c, F.lit(TWO_PI))


def polar(x: Column, y: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Radius and azimuth in [0, 2 pi)."""
    return F.hypot(x - cx, y - cy), turn(F.atan2(y - cy, x - cx))


def circular_mean(angle: Column) -> Column:
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def first_argmax(values: Column) -> Column:
    """0-based index of an array's largest element, the first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == label).cast("int"))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rec. 601."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def to_u8(c: Column) -> Column:
    """A value of [0, 1] as a byte, truncated."""
    return F.floor(clip(c, 0.0, 1.0) * 255).cast("int")


def airness(v: Column, air: Column, film: Column) -> Column:
    """How far a value lies from film towards air, in [0, 1.3]."""
    return clip((film - v) / (film - air), 0.0, 1.3)


def stretch(v: Column, lo: Column, hi: Column) -> Column:
    """Percentile normalisation into [0, 1]; 0 where the range is empty."""
    return F.when(hi - lo < 1e-8, F.lit(0.0)).otherwise(clip((v - lo) / (hi - lo + 1e-6), 0.0, 1.0))


def histogram_bin(v: Column, lo: float, hi: float, bins: int) -> Column:
    """0-based bin; the last one is closed on the right; NULL outside."""
    b = F.floor((v - lo) / ((hi - lo) / bins)).cast("int")
    return F.when((v >= lo) & (v <= hi), F.least(b, F.lit(bins - 1)))


def parabola_peak(left: Column, mid: Column, right: Column) -> Column:
    """Offset of a peak's vertex from its middle sample, within 1; 0 for a straight line."""
    bend = left - 2 * mid + right
    return F.when(bend == 0, F.lit(0.0)).otherwise(clip(0.5 * (left - right) / bend, -1.0, 1.0))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def hashed_uniform(*keys: Column, seed: int = 0) -> Column:
    """A reproducible number of [0, 1) that does not depend on partitioning."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(2**31)) / float(2**31)


def portable_uniform(*keys: Column, seed: int = 0) -> Column:
    """The same from MD5 of the keys' texts, which other engines have too; slower. Null keys count
    as absent."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)


def linspace_index(n_out: Column, n_in: Column, i: Column) -> Column:
    """Evenly spread indices of 0 .. n_in - 1, rounded half to even."""
    return F.when(n_out <= 1, F.lit(0)).otherwise(rint(i * (n_in - 1) / (n_out - 1)).cast("int"))


def spiral_angle(u: Column, r0: float, a: float, total: float) -> Column:
    """The angle at share u of a spiral's arc: solves a t^2 / 2 + r0 t = u * total."""
    return (F.sqrt(r0 * r0 + 2 * a * u * total) - r0) / a


def ordered(partition: list[str], *order) -> Window:
    return Window.partitionBy(*partition).orderBy(*order)


def running(partition: list[str], *order) -> Window:
    return ordered(partition, *order).rowsBetween(Window.unboundedPreceding, 0)


def centred(partition: list[str], half: int, *order) -> Window:
    return ordered(partition, *order).rowsBetween(-half, half)
