"""A synthetic wound strip, and the plan that flattens it again: trace, track, heal, arc, render.

Rasters are rows (z, row, px array): a slice is a group of a few thousand rows of a bounded size,
and the only thing that is ever gathered for one task. Everything that crosses slices is narrow.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions.semantics import hashed_uniform, spiral_angle
from lamina.kernels import walk
from lamina.kernels.image import bilinear
from lamina.operators import interp, ordered


@dataclass(frozen=True)
class Spiral:
    """A strip wound ``windings`` times from radius ``r0``, ``pitch`` apart, ``thick`` thick."""

    size: int = 160
    slices: int = 3
    windings: int = 4
    r0: float = 24.0
    pitch: float = 11.0
    thick: float = 5.0
    noise: float = 0.0
    seed: int = 7

    @property
    def slope(self) -> float:
        return self.pitch / (2 * math.pi)

    @property
    def length(self) -> float:
        t = 2 * math.pi * self.windings
        return self.r0 * t + self.slope * t * t / 2


def pattern(u: Column, z: Column) -> Column:
    """What the strip shows at arc length u and height z, in [0, 1]."""
    return 0.5 + 0.3 * F.sin(u / 9.0) + 0.2 * F.sin(u / 31.0 + z * 0.7)


def pattern_numpy(u: np.ndarray, z: float) -> np.ndarray:
    return 0.5 + 0.3 * np.sin(u / 9.0) + 0.2 * np.sin(u / 31.0 + z * 0.7)


def geometry(s: Spiral, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """(winding, on the strip, arc length) of a pixel, as expressions: the seam is at azimuth 0 and
    the angle is counted from the strip's inner end."""
    c = (s.size - 1) / 2
    r, t = F.hypot(x - c, y - c), F.pmod(F.atan2(y - c, x - c), F.lit(2 * math.pi))
    k = F.rint((r - s.r0 - s.slope * t) / s.pitch)
    total = t + 2 * math.pi * k
    on = (k >= 0) & (k < s.windings) & (F.abs(r - s.r0 - s.slope * total) <= s.thick / 2)
    return k.cast("int"), on, s.r0 * total + s.slope * total * total / 2


def generate(spark: SparkSession, s: Spiral) -> DataFrame:
    """z, row, label array (1 on the strip), px array."""
    cells = spark.range(s.slices * s.size * s.size).select((F.col("id") / (s.size * s.size)).cast("int").alias("z"), F.pmod((F.col("id") / s.size).cast("long"), F.lit(s.size)).cast("int").alias("row"), F.pmod("id", F.lit(s.size)).cast("int").alias("col"))
    _, on, u = geometry(s, F.col("col"), F.col("row"))
    value = F.when(on, pattern(u, F.col("z"))).otherwise(0.05) + s.noise * (hashed_uniform(F.col("z"), F.col("row"), F.col("col"), seed=s.seed) - 0.5)
    cells = cells.select("z", "row", "col", on.cast("int").alias("l"), value.alias("v"))
    pack = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("col", c))), lambda x: x[c])
    return cells.groupBy("z", "row").agg(pack("l").alias("label"), pack("v").alias("px"))


PATHS = "z int, walk_id int, seq int, x double, y double"


def _raster(pdf: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack(pdf.sort_values("row")[column].to_list())


def trace(slices: DataFrame, cx: float, cy: float, r0: float, r1: float, seam: float = 0.0) -> DataFrame:
    """Paths of the windings of each slice; a task holds one slice at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        paths = walk.trace(_raster(pdf, "label") > 0, cx, cy, r0, r1, seam)
        parts = [pd.DataFrame({"z": int(pdf["z"].iloc[0]), "walk_id": k, "seq": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]}) for k, p in enumerate(paths)]
        return pd.concat(parts) if parts else pd.DataFrame({"z": [], "walk_id": [], "seq": [], "x": [], "y": []})

    return slices.select("z", "row", "label").groupBy("z").applyInPandas(run, PATHS)


def profiles(paths: DataFrame, cx: float, cy: float, seam: float = 0.0, bins: int = 96) -> DataFrame:
    """roll, z, walk_id and the radius on even azimuths: one short row for each path."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = walk.profile(pdf.sort_values("seq")[["x", "y"]].to_numpy(), cx, cy, seam, bins)
        return pd.DataFrame({"z": [pdf["z"].iloc[0]], "walk_id": [pdf["walk_id"].iloc[0]], "r": [p.tolist()]})

    return paths.groupBy("z", "walk_id").applyInPandas(run, "z int, walk_id int, r array<double>")


def track(profile_rows: DataFrame, keys: list[str], near: float) -> DataFrame:
    """keys, z, walk_id, track_id. A roll's profiles (windings x slices short rows) are one group:
    the fold over z is sequential; different rolls run side by side. Where merged tracks both have a
    walk in a slice, that of the track seen most often (ties: the smaller walk_id) counts, the others
    are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, out = walk.Tracker(near), []
        for z, part in pdf.sort_values(["z", "walk_id"]).groupby("z"):
            ids = t.step(int(z), [np.array([np.nan if v is None else v for v in r], float) for r in part["r"]])
            out += [(*(pdf[k].iloc[0] for k in keys), int(z), int(w), i) for w, i in zip(part["walk_id"], ids, strict=True)]
        to, seen = t.merged(), [len(s) for s in t.seen]
        out.sort(key=lambda r: (r[-3], -seen[r[-1]], r[-2]))
        rows = pd.DataFrame([(*r[:-1], to.get(r[-1], r[-1])) for r in out], columns=[*keys, "z", "walk_id", "track_id"])
        return rows.drop_duplicates(["z", "track_id"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in profile_rows.schema if f.name in keys)
    return profile_rows.groupBy(*keys).applyInPandas(run, f"{kinds}, z int, walk_id int, track_id int")


def heal_over_z(table: DataFrame, half: int = 30, limit: float = 2.0) -> DataFrame:
    """(winding, bin, z, r) with radii further than ``limit`` from their running median over z
    interpolated between sound slices, if at least max(10, 30 %) of the bin's slices are sound:
    adds origin."""
    w = Window.partitionBy("winding", "bin").orderBy("z").rowsBetween(-half, half)
    rows = table.withColumn("_med", F.percentile("r", F.lit(0.5)).over(w))
    rows = rows.withColumn("_sound", F.col("r").isNotNull() & (F.abs(F.col("r") - F.col("_med")) <= limit))
    whole = Window.partitionBy("winding", "bin")
    rows = rows.withColumn("_quorum", F.count_if("_sound").over(whole) >= F.greatest(F.lit(10.0), 0.3 * F.count("*").over(whole)))
    keep = F.col("_sound") | ~F.col("_quorum")
    rows = ordered.fill_between(rows, ["winding", "bin"], "z", F.when(keep, F.col("r")), "_healed")
    return rows.withColumns({"r": F.when(keep, F.col("r")).otherwise(F.col("_healed")), "origin": F.when(keep, "walked").otherwise("healed")}).drop("_med", "_sound", "_quorum", "_healed")


def arc_surface(paths: DataFrame, px: float, seam: float, cx: float, cy: float) -> DataFrame:
    """Columns of even arc length along each winding's mean curve, shared by all slices:
    winding, col, phi."""
    bins = 720
    phi = F.pmod(F.atan2(F.col("y") - cy, F.col("x") - cx) - seam, F.lit(2 * math.pi))
    r = paths.select("winding", F.floor(phi / (2 * math.pi) * bins).alias("bin"), F.hypot(F.col("x") - cx, F.col("y") - cy).alias("r"))
    mean = r.groupBy("winding", "bin").agg(F.percentile("r", F.lit(0.5)).alias("r"))
    mean = mean.withColumn("phi", (F.col("bin") + 0.5) / bins * 2 * math.pi)
    s = ordered.spiral_arc_table(mean, ["winding"], "phi", "r")
    return interp.arc_columns(s, ["winding"], "s", "phi", px)


def render(slices: DataFrame, paths: DataFrame, surface: DataFrame, cx: float, cy: float, seam: float, taps: int = 3) -> DataFrame:
    """The strip (z, winding, col, v): pixels read along each path at the shared columns, averaged
    over ``taps`` along the normal. Slices meet their own paths alone; the columns, some thousands
    of numbers for a roll, go to every task."""
    spark = slices.sparkSession
    cols = spark.sparkContext.broadcast({k: v.sort_values("col")["phi"].to_numpy() for k, v in surface.toPandas().groupby("winding")})

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"z": [], "winding": [], "col": [], "v": []})
        image, out = _raster(left, "px"), []
        for k, p in right.sort_values("seq").groupby("winding"):
            if k not in cols.value:
                continue
            xy = p[["x", "y"]].to_numpy()
            phi, r = walk.azimuth_from(xy, cx, cy, seam), np.hypot(xy[:, 0] - cx, xy[:, 1] - cy)
            order = np.argsort(phi, kind="stable")
            at = cols.value[k]
            radius = np.interp(at, phi[order], r[order])
            v = np.mean([bilinear(image, cx + (radius + o) * np.cos(at + seam), cy + (radius + o) * np.sin(at + seam)) for o in np.arange(taps) - (taps - 1) / 2], axis=0)
            out.append(pd.DataFrame({"z": int(left["z"].iloc[0]), "winding": int(k), "col": np.arange(len(at)), "v": v}))
        return pd.concat(out) if out else pd.DataFrame({"z": [], "winding": [], "col": [], "v": []})

    return slices.select("z", "row", "px").groupBy("z").cogroup(paths.groupBy("z")).applyInPandas(run, "z int, winding int, col int, v double")


def unroll(spark: SparkSession, s: Spiral, px: float = 1.0) -> DataFrame:
    """From rasters to a flat strip: z, winding, col, v and the true value at that place."""
    slices = generate(spark, s).persist()
    c, r0, r1 = (s.size - 1) / 2, s.r0 - s.thick, s.r0 + s.pitch * (s.windings + 1)
    paths = trace(slices, c, c, r0, r1).persist()
    ids = track(profiles(paths, c, c).withColumn("roll", F.lit(0)), ["roll"], s.pitch / 2)
    middle = paths.join(ids, ["z", "walk_id"]).groupBy("track_id").agg(F.percentile(F.hypot(F.col("x") - c, F.col("y") - c), F.lit(0.5)).alias("r"))
    number = middle.withColumn("winding", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("r")) - 1).select("track_id", "winding")  # a row for each winding
    known = paths.join(ids, ["z", "walk_id"]).join(number, "track_id")
    surface = arc_surface(known, px, 0.0, c, c).persist()
    strip = render(slices, known, surface, c, c, 0.0)
    true_u = F.col("phi") + 2 * math.pi * F.col("winding")
    truth = pattern(s.r0 * true_u + s.slope * true_u * true_u / 2, F.col("z"))
    return strip.join(surface, ["winding", "col"]).select("z", "winding", "col", "v", truth.alias("truth"))


def analytic_point(s: Spiral, share: Column) -> tuple[Column, Column]:
    """(x, y) at a share of the strip's length."""
    t = spiral_angle(share, s.r0, s.slope, s.length)
    r, c = s.r0 + s.slope * t, (s.size - 1) / 2
    return c + r * F.cos(t), c + r * F.sin(t)
