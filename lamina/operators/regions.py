"""Regions and distances in stacks of slices that no task could hold: components by six neighbours,
and exact distance transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.semantics import ordered
from lamina.kernels import image
from lamina.sources.scratch import settle

#: Bits of a row's and of a column's number in a voxel's number.
_BITS = 21


def connected(edges: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, node, root for each node of an edge: root is the least node that can be reached. Each
    round hooks every node to its least neighbour, follows the hooks once more and contracts the
    edges, so rounds grow with the logarithm of a region's extent. Loops and repeats are ignored."""
    left = settle(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    root = left.select(*keys, F.col("a").alias("node")).union(left.select(*keys, "b")).distinct().withColumn("root", F.col("node"))
    left = left.where("a <> b")
    while not left.isEmpty():
        both = left.union(left.select(*keys, "b", "a"))
        hook = settle(both.groupBy(*keys, "a").agg(F.min("b").alias("b")).select(*keys, "a", F.least("a", "b").alias("to")))
        then = hook.select(*keys, F.col("a").alias("to"), F.col("to").alias("_then"))
        hook = settle(hook.join(then, [*keys, "to"]).select(*keys, "a", F.col("_then").alias("to")))
        of = lambda c: hook.select(*keys, F.col("a").alias(c), F.col("to").alias(f"_{c}"))
        moved = left.join(of("a"), [*keys, "a"]).join(of("b"), [*keys, "b"]).where("_a <> _b")
        left = settle(moved.select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        root = settle(root.join(of("root"), [*keys, "root"], "left").select(*keys, "node", F.coalesce("_root", "root").alias("root")))
    return root


def voxel(z: Column, row: Column, col: Column) -> Column:
    """A voxel's number: in the order of z, row and column."""
    return z.cast("long") * 2 ** (2 * _BITS) + row.cast("long") * 2**_BITS + col.cast("long")


def _label(on: np.ndarray) -> np.ndarray:
    """For each voxel of ``on`` the place, in reading order, of its component's first voxel; else -1.
    Slices are labelled one by one and joined through voxels above each other."""
    n = on.shape[1] * on.shape[2]
    out = np.full(on.shape, -1, np.int64)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for z, slice_ in enumerate(on):
        labels, k = image.components(slice_)
        if not k:
            continue
        flat = labels.ravel()
        first = np.full(k + 1, -1, np.int64)
        places = np.flatnonzero(flat)
        first[flat[places[::-1]]] = places[::-1] + z * n
        out[z] = np.where(labels > 0, first[labels], -1)
        parent.update((p, p) for p in first[1:].tolist())
        if z:
            touch = (out[z] >= 0) & (out[z - 1] >= 0)
            for p, q in np.unique(np.stack([out[z - 1][touch], out[z][touch]]), axis=1).T.tolist():
                p, q = find(p), find(q)
                parent[max(p, q)] = min(p, q)
    roots = {p: find(p) for p in parent}
    known = np.array(sorted(roots), np.int64)
    to = np.array([roots[p] for p in known.tolist()], np.int64)
    there = out >= 0
    out[there] = to[np.searchsorted(known, out[there])]
    return out


def label_regions(blocks: DataFrame, keys: list[str], z: str, row: str, depth: int, height: int, width: int) -> DataFrame:
    """keys, z, row, block, labels of stacks (keys, z, row, block, values) whose values above 0 are on:
    for each voxel its region's least voxel number (see voxel()), NULL where off.

    Regions are joined by faces. Each block of ``depth`` x ``height`` x ``width`` voxels is labelled by
    itself; voxels on its far faces look for their neighbour in the next block, and only the labels
    of such pairs are contracted, over the cluster. Null samples and missing rows are off; no blocks
    give none. Slices, rows and columns number fewer than 2^21."""
    types = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)
    names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z0, y0, b = int(pdf["_z"].min()), int(pdf["_y"].min()), int(pdf["block"].iloc[0])
        on = np.zeros((int(pdf["_z"].max()) - z0 + 1, int(pdf["_y"].max()) - y0 + 1, max(map(len, pdf["values"]))), bool)
        for k, y, v in zip(pdf["_z"], pdf["_y"], pdf["values"], strict=True):
            on[k - z0, y - y0, : len(v)] = np.nan_to_num(np.asarray(v, float)) > 0
        place = _label(on)
        k, rest = np.divmod(place, on.shape[1] * on.shape[2])
        y, x = np.divmod(rest, on.shape[2])
        number = np.where(place >= 0, (k + z0 << 2 * _BITS) + (y + y0 << _BITS) + x + b * width, -1)
        made = pd.DataFrame({"z": pdf["_z"], "row": pdf["_y"], "block": b, "labels": [[None if n < 0 else n for n in number[k - z0, y - y0, : len(v)].tolist()] for k, y, v in zip(pdf["_z"], pdf["_y"], pdf["values"], strict=True)]})
        for i, c in enumerate(names):
            made.insert(i, c, pdf[c].iloc[0])
        return made

    rows = blocks.select(*keys, F.floor(F.col(z) / depth).alias("_zb"), F.floor(F.col(row) / height).alias("_yb"), F.col(z).cast("long").alias("_z"), F.col(row).cast("long").alias("_y"), F.col("block").cast("int").alias("block"), "values")
    made = rows.groupBy(*keys, "_zb", "_yb", "block").applyInPandas(run, f"{types}{', ' if types else ''}z long, row long, block int, labels array<long>")
    made = settle(made)
    at = F.struct(F.col("z"), F.col("row"), (F.col("block") * width + F.col("_i")).alias("col"), F.col("_l").alias("label"))
    voxels = made.select(*keys, "z", "row", "block", F.posexplode("labels").alias("_i", "_l")).where("_l IS NOT NULL").select(*keys, at.alias("v"))
    far, near = [], []
    for c, size in (("z", depth), ("row", height), ("col", width)):
        p = F.col(f"v.{c}")
        far.append(F.when(p % size == size - 1, voxel(*(F.col(f"v.{x}") + int(x == c) for x in ("z", "row", "col")))))
        near.append(p % size == 0)
    sent = voxels.select(*keys, F.explode(F.array_compact(F.array(*far))).alias("_at"), F.col("v.label").alias("a"))
    met = voxels.where(near[0] | near[1] | near[2]).select(*keys, voxel(F.col("v.z"), F.col("v.row"), F.col("v.col")).alias("_at"), F.col("v.label").alias("b"))
    roots = connected(sent.join(met, [*keys, "_at"]).select(*keys, "a", "b").distinct(), keys)
    # a block's changed labels travel to it as one map: not more than its faces have voxels
    held = made.select(*keys, "z", "row", "block", F.explode(F.array_distinct(F.filter("labels", lambda x: x.isNotNull()))).alias("node"))
    changed = held.join(roots.where("node <> root"), [*keys, "node"]).groupBy(*keys, "z", "row", "block").agg(F.map_from_entries(F.collect_list(F.struct("node", "root"))).alias("_to"))
    out = made.join(changed, [*keys, "z", "row", "block"], "left")
    labels = F.when(F.col("_to").isNull(), F.col("labels")).otherwise(F.transform("labels", lambda x: F.when(x.isNotNull(), F.coalesce(F.try_element_at(F.col("_to"), x), x))))
    return out.select(*keys, "z", "row", "block", labels.alias("labels"))


def _envelope(f: np.ndarray) -> np.ndarray:
    """min over q of (p - q)^2 + f[q] for every p, by the lower envelope of these parabolas; infinite
    ones are left out."""
    own = np.flatnonzero(np.isfinite(f))
    if not len(own):
        return f
    hull, starts = [int(own[0])], [-np.inf]
    for q in own[1:].tolist():
        while True:
            p = hull[-1]
            s = (f[q] + q * q - f[p] - p * p) / (2.0 * (q - p))
            if s > starts[-1]:
                break
            hull.pop()
            starts.pop()
        hull.append(q)
        starts.append(s)
    at = np.arange(len(f))
    best = np.array(hull)[np.searchsorted(starts, at, side="right") - 1]
    return (at - best) ** 2 + f[best]


def squared_distances(blocks: DataFrame, keys: list[str], row: str, width: int) -> DataFrame:
    """keys, row, block, values: for each pixel the squared distance to the nearest pixel whose value is
    above 0, exact; NULL where an image has none.

    First along rows: the nearest feature in a block, in those before it or in those behind it, of which
    a row's window knows the last and the first. Then along columns: the lower envelope of a
    parabola for each row, one block of columns at a time. Null samples are no features. Rows of an
    image are numbered without gaps; no blocks give none."""
    base = F.col("block") * width
    on = F.filter(F.transform("values", lambda v, i: F.when(v > 0, i.cast("long") + base)), lambda i: i.isNotNull())
    w = ordered([*keys, row], "block")
    last = F.max(F.array_max("_on")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min(F.array_min("_on")).over(w.rowsBetween(1, Window.unboundedFollowing))
    seen = blocks.withColumn("_on", on).withColumns({"_last": last, "_first": first})
    types = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)
    names = list(keys)

    def along(n: int, start: int, features: np.ndarray, before: float, behind: float) -> np.ndarray:
        places = np.concatenate([[before] if before == before else [], features, [behind] if behind == behind else []])
        at = np.arange(start, start + n, dtype=float)
        if not len(places):
            return np.full(n, np.inf)
        k = np.searchsorted(places, at)
        low, high = places[np.maximum(k - 1, 0)], places[np.minimum(k, len(places) - 1)]
        return np.minimum(np.abs(at - low), np.abs(at - high)) ** 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("_y")
        b = int(p["block"].iloc[0])
        a = np.stack([along(n, b * width, np.asarray(f, float), lo, hi) for n, f, lo, hi in zip(p["_n"], p["_on"], p["_last"].astype(float), p["_first"].astype(float), strict=True)])
        a = np.stack([_envelope(c) for c in a.T], axis=1)
        made = pd.DataFrame({row: p["_y"], "block": b, "values": [[int(x) if x < np.inf else None for x in y] for y in a.tolist()]})
        for i, c in enumerate(names):
            made.insert(i, c, p[c].iloc[0])
        return made

    rows = seen.select(*keys, F.col(row).cast("long").alias("_y"), F.col("block").cast("int").alias("block"), F.size("values").alias("_n"), "_on", "_last", "_first")
    return rows.groupBy(*keys, "block").applyInPandas(run, f"{types}{', ' if types else ''}{row} long, block int, values array<long>")
