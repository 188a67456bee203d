"""Operators that alternate two distributed steps until nothing changes: quantiles by narrowing
histograms, curves refitted from sums, profiles locked to their median, robust local lines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.semantics import MAD_SCALE, TWO_PI, median, number, ordered, rint
from lamina.operators.matching import banded
from lamina.sources.scratch import settle


def exact_quantiles(df: DataFrame, value: str, shares: list[float], bins: int = 4096) -> list[float | None]:
    """What percentile() gives for each share, without sorting or holding the values: a pass counts each
    wanted rank's interval in ``bins`` bins, the bin that holds the rank is the next interval, until it
    holds one value. The driver sees two ranks x bins counts for each share. NaN and NULL are left
    out; without values all are None."""
    v = number(F.col(value))
    rows = df.select(v.alias("v")).where("v IS NOT NULL")
    n, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    ranks = sorted({r for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))})
    found: dict[int, float] = {}
    open_ = dict.fromkeys(ranks, (lo, hi, 0))  # interval that holds the rank, and how many lie below it
    while open_:
        for r in [r for r, (a, b, _) in open_.items() if a == b]:
            found[r] = open_.pop(r)[0]
        spans = sorted({(a, b) for a, b, _ in open_.values()})
        if not spans:
            break
        hits = []
        for k, (a, b) in enumerate(spans):
            at = F.least(F.floor((F.col("v") - a) * (bins / (b - a))), F.lit(bins - 1)) if b - a < math.inf and bins / (b - a) < math.inf else F.when(F.col("v") == b, 1).otherwise(0)
            hits.append(F.when(F.col("v").between(a, b), F.struct(F.lit(k).alias("k"), at.cast("int").alias("bin"))))
        counted = rows.withColumn("h", F.explode(F.array_compact(F.array(*hits)))).groupBy("h.k", "h.bin").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        by_span: dict[int, list] = {}
        for c in sorted(counted, key=lambda c: (c["k"], c["bin"])):
            by_span.setdefault(c["k"], []).append(c)
        for r, (a, b, below) in list(open_.items()):
            for c in by_span[spans.index((a, b))]:
                if r < below + c["n"]:
                    open_[r] = (c["a"], c["b"], below)
                    break
                below += c["n"]
    out = []
    for s in shares:
        at = s * (n - 1)
        low, high = found[math.floor(at)], found[math.ceil(at)]
        out.append(low + (high - low) * (at - math.floor(at)))
    return out


def fit_spirals(points: DataFrame, keys: list[str], phi: str, r: str, windings: int, start: tuple[float, float], harmonics: int = 0, gate: float | None = None, rounds: int = 5) -> DataFrame:
    """keys, coefficients, n, rounds: r = c0 + c1 (k + phi / 2 pi) + sums of cos and sin of phi and its
    multiples, where each point belongs to the winding k (0 .. windings - 1) whose curve is nearest,
    within ``gate``.

    Each round assigns the points by the last curve, of which there is one row for each key, and refits it
    from sums of products: points are only ever counted and added up, never brought together. It ends
    when no point changes its winding or after ``rounds``. Points with NULL or NaN take no part; a key
    whose points don't fix a curve keeps the last one. Angles are radians."""
    turn = F.col("_phi") / TWO_PI
    waves = [f(m * F.col("_phi")) for m in range(1, harmonics + 1) for f in (F.cos, F.sin)]
    width = 2 + len(waves)
    own = points.select(*keys, number(F.col(phi)).alias("_phi"), number(F.col(r)).alias("_r")).where("_phi IS NOT NULL AND _r IS NOT NULL")
    curve = own.select(*keys).distinct().withColumn("coefficients", F.array(*[F.lit(float(c)) for c in (*start, *[0.0] * len(waves))])).withColumns({"n": F.lit(0).cast("long"), "_sum": F.lit(None).cast("double"), "rounds": F.lit(0)})
    types = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys)
    names = list(keys)

    def solve(parts):
        for pdf in parts:
            out = []
            for m, old in zip(pdf["_m"], pdf["coefficients"], strict=True):
                m = np.asarray(m, float)
                a, b = np.zeros((width, width)), m[-width:]
                a[np.triu_indices(width)] = m[:-width]
                a = a + np.triu(a, 1).T
                out.append(np.linalg.solve(a, b).tolist() if np.linalg.matrix_rank(a) == width else list(old))
            yield pd.DataFrame({**{k: pdf[k] for k in names}, "coefficients": out, "n": pdf["n"], "_sum": pdf["_sum"]})

    for k in range(1, rounds + 1):
        c = [F.get("coefficients", i) for i in range(width)]
        rest = sum((ci * wave for ci, wave in zip(c[2:], waves, strict=True)), F.lit(0.0))
        winding = F.least(F.greatest(rint((F.col("_r") - c[0] - rest) / c[1] - turn), F.lit(0.0)), F.lit(float(windings - 1)))
        at = own.join(curve.select(*keys, "coefficients"), keys).withColumn("_k", winding)
        if gate is not None:
            at = at.where(F.abs(F.col("_r") - c[0] - c[1] * (F.col("_k") + turn) - rest) <= gate)
        x = [F.lit(1.0), F.col("_k") + turn, *waves]
        products = [F.sum(x[i] * x[j]) for i in range(width) for j in range(i, width)] + [F.sum(x[i] * F.col("_r")) for i in range(width)]
        sums = at.groupBy(*keys).agg(F.array(*products).alias("_m"), F.count("*").alias("n"), F.sum(F.col("_k") * (1 + F.xxhash64("_phi", "_r") % 1000)).alias("_sum"))
        new = sums.join(curve.select(*keys, "coefficients", F.col("_sum").alias("_old")), keys)
        fitted = new.select(*keys, "_m", "coefficients", "n", "_sum").mapInPandas(solve, f"{types}{', ' if types else ''}coefficients array<double>, n long, _sum double")
        before = curve.select(*keys, F.col("coefficients").alias("_c"), F.col("_sum").alias("_s"), F.col("n").alias("_n"))
        curve = settle(before.join(fitted, keys, "left").select(*keys, F.coalesce("coefficients", "_c").alias("coefficients"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "_sum", F.lit(k).alias("rounds"), (F.col("_sum").eqNullSafe(F.col("_s")) & (F.col("n") == F.col("_n"))).alias("_same")))
        if curve.where("NOT coalesce(_same, false)").isEmpty():
            break
    return curve.select(*keys, "coefficients", "n", "rounds")


def lock_profiles(df: DataFrame, keys: list[str], frame: str, at: str, value: str, limit: int, rounds: int = 3) -> DataFrame:
    """keys, frame, shift: how far each frame's profile (integer places ``at``) lies behind the median
    of all profiles of its key, that median found again from moved profiles.

    A shift is the one of -limit .. limit with the least mean squared difference where half the profile
    or more overlaps; of equal ones the smallest in size, then the negative one. Medians are grouped by
    place and shifts by frame: a reel is never one group. NULL and NaN samples are left out; a frame without
    enough samples keeps 0."""
    own = df.select(*keys, frame, F.col(at).cast("long").alias("_at"), number(F.col(value)).alias("_v")).where("_v IS NOT NULL")
    shifts = df.select(*keys, frame).distinct().withColumn("shift", F.lit(0).cast("long"))
    size = own.groupBy(*keys, frame).agg(F.count("*").alias("_n"))
    for _ in range(rounds):
        moved = own.join(shifts, [*keys, frame]).withColumn("_to", F.col("_at") - F.col("shift"))
        middle = moved.groupBy(*keys, "_to").agg(median(F.col("_v")).alias("_m"))
        tried = own.withColumn("_s", F.explode(F.sequence(F.lit(-limit), F.lit(limit)))).withColumn("_to", F.col("_at") - F.col("_s"))
        scored = tried.join(middle, [*keys, "_to"]).groupBy(*keys, frame, "_s").agg(F.avg((F.col("_v") - F.col("_m")) ** 2).alias("_e"), F.count("*").alias("_k"))
        sound = scored.join(size, [*keys, frame]).where("2 * _k >= _n")
        best = sound.groupBy(*keys, frame).agg(F.min(F.struct(F.round("_e", 12).alias("e"), F.abs("_s").alias("a"), F.col("_s").alias("s"))).alias("_b"))
        new = shifts.select(*keys, frame).join(best, [*keys, frame], "left").select(*keys, frame, F.coalesce(F.col("_b.s"), F.lit(0)).cast("long").alias("shift"))
        shifts = settle(new)
    return shifts


def local_lines(df: DataFrame, keys: list[str], at: str, value: str, sigma: float, rounds: int = 1, limit: float = 4.0, reach: float = 4.0) -> DataFrame:
    """keys, at, value, smooth: at each place the line through its neighbours, weighed by a Gaussian of
    ``sigma`` that ends at ``reach`` sigmas. After each round but the last, places whose residual exceeds
    ``limit`` scaled MADs of their key's lose their weight, for others' lines and their own.

    Neighbours meet by buckets of their reach, and a line is five sums. Fewer than two places with
    weight, or all at one place, give their weighted mean; none gives NULL. Places are distinct in a
    key; NULL or NaN values have no weight but get a line."""
    own = df.select(*keys, F.col(at).cast("double").alias(at), F.col(value)).withColumn("_v", number(F.col(value)))
    weighed = own.where("_v IS NOT NULL")
    for k in range(rounds):
        other = weighed.select(*keys, F.col(at).alias("_u"), F.col("_v").alias("_w"))
        pairs = banded(own.select(*keys, at), other, keys, at, "_u", reach * sigma)
        d = F.col("_u") - F.col(at)
        g = F.exp(-0.5 * (d / sigma) ** 2)
        s = pairs.groupBy(*keys, at).agg(F.sum(g).alias("s0"), F.sum(g * d).alias("s1"), F.sum(g * d * d).alias("s2"), F.sum(g * F.col("_w")).alias("t0"), F.sum(g * d * F.col("_w")).alias("t1"))
        det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
        line = F.when(det > 1e-9 * F.col("s0") * F.col("s0") * sigma * sigma, (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det).otherwise(F.col("t0") / F.col("s0"))
        smooth = own.join(s.select(*keys, at, line.alias("smooth")), [*keys, at], "left")
        if k + 1 < rounds:
            smooth = settle(smooth)
            off = smooth.withColumn("_d", F.abs(F.col("_v") - F.col("smooth"))).where("_d IS NOT NULL")
            spread = off.groupBy(*keys).agg((MAD_SCALE * median(F.col("_d"))).alias("_mad"))
            weighed = off.join(spread, keys).where(F.col("_d") <= limit * F.col("_mad") + 1e-12)
    return smooth.select(*keys, at, value, "smooth")


def held_places(measures: DataFrame, steps: DataFrame, keys: list[str], order: str, least: float, pitch: float) -> DataFrame:
    """keys, order, x, z, locked: places of frames, numbered from 0, on a strip.

    ``measures`` hold a guessed place x0 and, where a frame was compared with its true picture, along,
    across and score; it is locked if the score exceeds ``least`` and along is within half a ``pitch``.
    Unlocked frames between two locked ones go from the left one step by step by what neighbours say
    (``steps``: for a frame, along and across against the one before it; NULL if unknown: the mean
    step of guesses); what is then left at the right anchor is spread evenly over the gap. Beyond the
    last anchor the steps alone count, before the first one they count backwards. z is corrected the same
    way. A key without locked frames keeps its guesses. Gaps are islands of one window over small
    rows, one for each frame."""
    m = measures.select(*keys, order, F.col("x0").cast("double").alias("x0"), *[number(F.col(c)).alias(c) for c in ("along", "across", "score")])
    locked = F.coalesce((F.col("score") > least) & (F.abs(F.col("along")) <= pitch / 2) & F.col("across").isNotNull(), F.lit(False))
    rows = m.join(steps.select(*keys, order, number(F.col("along")).alias("_da"), number(F.col("across")).alias("_dz")), [*keys, order], "left").withColumn("locked", locked)
    w = ordered(keys, order)
    all_ = Window.partitionBy(*keys)
    mean = (F.max_by("x0", order).over(all_) - F.min_by("x0", order).over(all_)) / F.nullif(F.max(order).over(all_) - F.min(order).over(all_), F.lit(0))
    rows = rows.withColumns({"_sx": F.coalesce(mean + F.coalesce("_da", F.lit(0.0)), F.lit(0.0)), "_sz": F.coalesce("_dz", F.lit(0.0))})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_px": F.sum("_sx").over(upto), "_pz": F.sum("_sz").over(upto)})  # paths of the steps alone
    anchor = F.when(F.col("locked"), F.struct(F.col(order).alias("k"), (F.col("x0") + F.col("along")).alias("x"), F.col("across").alias("z"), F.col("_px").alias("px"), F.col("_pz").alias("pz")))
    rows = rows.withColumns({"_l": F.last(anchor, ignorenulls=True).over(upto), "_r": F.first(anchor, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})

    def place(c: str, path: str) -> Column:
        left = F.col(f"_l.{c}") + F.col(path) - F.col(f"_l.p{c}")
        right = F.col(f"_r.{c}") + F.col(path) - F.col(f"_r.p{c}")
        share = F.try_divide(F.col(order) - F.col("_l.k"), F.col("_r.k") - F.col("_l.k"))
        # what the steps from the left miss at the right anchor is the same for the whole gap
        miss = F.col(f"_r.{c}") - (F.col(f"_l.{c}") + F.col(f"_r.p{c}") - F.col(f"_l.p{c}"))
        return F.coalesce(left + F.coalesce(share, F.lit(0.0)) * miss, left, right)

    return rows.select(*keys, order, F.coalesce(place("x", "_px"), F.col("x0")).alias("x"), F.coalesce(place("z", "_pz"), F.lit(0.0)).alias("z"), "locked")
