"""Strips larger than a task. A strip is rows of arrays cut into blocks of ``width`` samples: keys, row,
block, values; rows and blocks count from 0 without gaps, and only the last block of a row may be
shorter. A task holds one block of ``height`` rows and its margins, never a strip."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.semantics import lerp, ordered


def to_blocks(strip: DataFrame, keys: list[str], row: str, values: str, width: int) -> DataFrame:
    """keys, row, block, values (doubles) of rows of whole arrays. Null or empty arrays give no block."""
    n = F.ceil(F.size(values) / width).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(values, b * width + 1, width))
    rows = strip.where(F.size(values) > 0).select(*keys, row, F.posexplode(cut).alias("block", "values"))
    return rows.withColumn("values", F.transform("values", lambda v: v.cast("double")))


def whole_rows(blocks: DataFrame, keys: list[str], row: str) -> DataFrame:
    """The rows that to_blocks() cut: keys, row, values."""
    parts = F.array_sort(F.collect_list(F.struct("block", "values")))
    return blocks.groupBy(*keys, row).agg(F.flatten(F.transform(parts, lambda p: p["values"])).alias("values"))


def map_blocks(blocks: DataFrame, keys: list[str], row: str, height: int, width: int, margin: int, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Blocks of ``f`` of each strip, where ``f`` turns an image into one of the same shape and looks at
    most ``margin`` pixels away: each block is seen with that much of its neighbours, whose share is
    cut off again. At a strip's own borders there is no margin, so ``f`` meets them as they are. Null
    samples and missing parts are NaN to ``f``, and NaN results are NULL. No blocks give none."""
    if margin > width:
        raise ValueError("a margin reaches into one neighbour only")
    r, v = F.col(row), F.col("values")
    own = F.array(F.struct(F.lit(0).alias("side"), F.col("block").alias("to_block"), v.alias("part")))
    left = F.when(F.col("block") > 0, F.array(F.struct(F.lit(1).alias("side"), (F.col("block") - 1).alias("to_block"), F.slice(v, 1, margin).alias("part"))))
    right = F.when(F.size(v) == width, F.array(F.struct(F.lit(-1).alias("side"), (F.col("block") + 1).alias("to_block"), F.slice(v, width - margin + 1, margin).alias("part"))))
    none = F.array().cast(blocks.select(own.alias("x")).schema["x"].dataType)
    sent = F.concat(own, F.coalesce(left, none), F.coalesce(right, none)) if margin else own
    bands = F.sequence(F.floor(F.greatest(r - margin, F.lit(0)) / height), F.floor((r + margin) / height))
    pieces = blocks.withColumn("_band", F.explode(bands)).withColumn("_p", F.explode(sent))
    pieces = pieces.select(*keys, "_band", r.cast("long").alias("_row"), F.col("_p.side").alias("_side"), F.col("_p.to_block").cast("int").alias("block"), F.col("_p.part").alias("_part"))
    names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        band = int(pdf["_band"].iloc[0])
        sizes = {s: max(map(len, pdf.loc[pdf["_side"] == s, "_part"]), default=0) for s in (-1, 0, 1)}
        first, last = int(pdf["_row"].min()), int(pdf["_row"].max())
        mine = range(max(first, band * height), min(last + 1, (band + 1) * height))
        rows = pdf.loc[pdf["_side"] == 0, "_row"]
        if not sizes[0] or not len(mine) or not rows.between(mine[0], mine[-1]).any():
            return pd.DataFrame(columns=[*names, row, "block", "values"])
        a = np.full((last - first + 1, sum(sizes.values())), np.nan)
        at = {-1: 0, 0: sizes[-1], 1: sizes[-1] + sizes[0]}
        for y, side, part in zip(pdf["_row"], pdf["_side"], pdf["_part"], strict=True):
            start = at[side] + (sizes[-1] - len(part) if side < 0 else 0)
            a[y - first, start : start + len(part)] = np.asarray(part, float)
        out = np.asarray(f(a), float)[mine[0] - first : mine[-1] + 1 - first, sizes[-1] : sizes[-1] + sizes[0]]
        there = set(rows)
        kept = [y for y in mine if y in there]
        made = pd.DataFrame({row: kept, "block": int(pdf["block"].iloc[0]), "values": [[None if x != x else x for x in out[y - mine[0]].tolist()] for y in kept]})
        for i, k in enumerate(names):
            made.insert(i, k, pdf[k].iloc[0])
        return made

    types = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)
    return pieces.groupBy(*keys, "_band", "block").applyInPandas(run, f"{types}{', ' if types else ''}{row} long, block int, values array<double>")


def sample(points: DataFrame, blocks: DataFrame, keys: list[str], row: str, height: int, width: int, y: Column, x: Column, name: str = "v") -> DataFrame:
    """``points`` with the strip's bilinear value at (y, x) as ``name``; NULL outside, beside a missing
    sample that would count, and for null places. Points meet one block each, with the row and the
    column beyond it: one join on the block's number."""
    after = F.lead("values").over(ordered([*keys, row], "block"))
    wide = blocks.withColumn("values", F.concat("values", F.coalesce(F.slice(after, 1, 1), F.array().cast("array<double>"))))
    r = F.col(row).cast("long")
    bands = F.when((r % height == 0) & (r > 0), F.array(F.floor(r / height), F.floor(r / height) - 1)).otherwise(F.array(F.floor(r / height)))
    tiles = wide.select(*keys, F.explode(bands).alias("_band"), F.col("block").alias("_block"), F.struct(r.alias("r"), F.col("values").alias("v")).alias("_r"))
    tiles = tiles.groupBy(*keys, "_band", "_block").agg(F.map_from_entries(F.collect_list("_r")).alias("_tile"))
    fy, fx = F.floor(F.col("_y")), F.floor(F.col("_x"))
    p = points.withColumns({"_y": y.cast("double"), "_x": x.cast("double")})
    p = p.withColumns({"_band": F.floor(fy / height), "_block": F.floor(fx / width).cast("int")})
    j = (fx - F.col("_block") * width).cast("int")

    def across(line: Column) -> Column:
        a, b, t = F.get(line, j), F.get(line, j + 1), F.col("_x") - fx
        return F.when(t == 0, a).otherwise(lerp(a, b, t))

    low, high = (across(F.try_element_at(F.col("_tile"), fy + k)) for k in (0, 1))
    t = F.col("_y") - fy
    inside = (F.col("_y") >= 0) & (F.col("_x") >= 0)
    out = F.when(inside & (t == 0), low).when(inside, lerp(low, high, t))
    return p.join(tiles, [*keys, "_band", "_block"], "left").withColumn(name, out).select(*points.columns, name)


def on_rail(places: DataFrame, rails: DataFrame, keys: list[str], u: str, bucket: float, columns: list[str]) -> DataFrame:
    """``places`` with the piecewise linear ``columns`` of the rail at ``u``; the ends hold. Spans between
    knots meet places by buckets of u. Knots are distinct in (keys, u); places without a rail go."""
    w = ordered(keys, u)
    spans = rails.withColumns({"_u1": F.lead(u).over(w), **{f"_{c}1": F.lead(c).over(w) for c in columns}})
    ends = rails.groupBy(*keys).agg(F.min(u).alias("_lo"), F.max(u).alias("_hi"))
    last = F.col("_u1").isNull()
    spans = spans.select(*keys, F.col(u).alias("_u0"), F.coalesce("_u1", u).alias("_u1"), *[F.struct(F.col(c).alias("a"), F.coalesce(f"_{c}1", c).alias("b")).alias(f"_{c}") for c in columns], last.alias("_last"))
    of = lambda c: F.floor(c / bucket)
    spans = spans.withColumn("_bucket", F.explode(F.sequence(of(F.col("_u0")), of(F.col("_u1")))))
    held = places.join(ends, keys).withColumn("_at", F.least(F.greatest(F.col(u), F.col("_lo")), F.col("_hi")))
    hit = held.withColumn("_bucket", of(F.col("_at"))).join(spans, [*keys, "_bucket"])
    hit = hit.where((F.col("_at") >= F.col("_u0")) & ((F.col("_at") < F.col("_u1")) | F.col("_last") & (F.col("_at") == F.col("_u0"))))
    t = F.coalesce(F.try_divide(F.col("_at") - F.col("_u0"), F.col("_u1") - F.col("_u0")), F.lit(0.0))
    return hit.select(*places.columns, *[lerp(F.col(f"_{c}.a"), F.col(f"_{c}.b"), t).alias(c) for c in columns])


def rectify(blocks: DataFrame, rails: DataFrame, keys: list[str], row: str, height: int, width: int, nominal: tuple[float, float], pitch: float, phase: float = 0.0, rows: tuple[float, int] = (0.0, 1)) -> DataFrame:
    """keys, cell, row, values: upright frames of strips between two rails (keys, side 0 or 1, and at a
    nominal place u along the strip the real y and x).

    Cell k spans ``pitch`` samples from k * pitch + phase on, for whole cells between the rails' common
    ends. Its line i is ``rows[0]`` + i, for ``rows[1]`` lines; a line at nominal[0] lies on rail 0, one at
    nominal[1] on rail 1, others on the straight line through both. Samples outside the strip are
    NULL. A strip without both rails gives none. Every pixel is a row on its way, so no task
    holds a strip."""
    ends = rails.groupBy(*keys, "side").agg(F.min("u").alias("a"), F.max("u").alias("b"))
    common = ends.groupBy(*keys).agg(F.max("a").alias("a"), F.min("b").alias("b"), F.count("*").alias("n")).where("n = 2")
    first, last = F.ceil(F.col("a") / pitch), F.floor(F.col("b") / pitch) - 1
    cells = common.where(last >= first).select(*keys, F.explode(F.sequence(first, last)).alias("cell"))
    u = F.col("cell") * pitch + phase + F.col("col")
    places = cells.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(round(pitch) - 1)))).withColumn("u", u.cast("double"))
    for side in (0, 1):
        rail = rails.where(F.col("side") == side).select(*keys, F.col("u").cast("double").alias("u"), F.col("y").alias(f"y{side}"), F.col("x").alias(f"x{side}"))
        places = on_rail(places, rail, keys, "u", pitch, [f"y{side}", f"x{side}"])
    lines = places.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(rows[1] - 1))))
    t = (F.col("line") + rows[0] - nominal[0]) / (nominal[1] - nominal[0])
    seen = sample(lines, blocks, keys, row, height, width, lerp(F.col("y0"), F.col("y1"), t), lerp(F.col("x0"), F.col("x1"), t))
    parts = F.array_sort(F.collect_list(F.struct("col", "v")))
    return seen.groupBy(*keys, "cell", F.col("line").alias("row")).agg(F.transform(parts, lambda p: p["v"]).alias("values"))
