"""Operators on frames, slices and series that are rows: each row holds its pixels (in reading order) or
samples in an array, with as many keys beside it as the caller likes. Rows are independent, so nothing is
shuffled and a task holds one row's array at a time.

Nulls and ties, for all of them: a null array, or one with a null or NaN in it, gives NULL results (no rows,
where rows are made); keys may repeat; of equal candidates the first in order wins, as each operator
says. Empty tables give none. Centres are (x, y)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.semantics import rint
from lamina.kernels import image, signal, walk

Shape = tuple[int, int]


def _plain(v):
    if isinstance(v, np.ndarray):
        return [None if x != x else x for x in v.ravel().tolist()]
    if isinstance(v, (list, tuple)):
        return list(v)
    return None if v is None or v != v else v.item() if isinstance(v, np.generic) else v


def per_row(df: DataFrame, keys: list[str], arrays: list[str], fields: dict[str, str], f: Callable[..., tuple]) -> DataFrame:
    """keys and ``fields`` (name: type), which ``f`` makes of a row's arrays as a tuple."""
    names, columns = list(keys), list(fields)

    def run(parts):
        for pdf in parts:
            out = []
            for row in zip(*(pdf[a] for a in arrays), strict=True):
                got = [None if v is None else np.asarray(v, float) for v in row]
                out.append([None] * len(columns) if any(v is None or np.isnan(v).any() for v in got) else [_plain(v) for v in f(*got)])
            made = {c: pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate(columns)}
            yield pd.DataFrame({**{k: pdf[k] for k in names}, **{c: v.set_axis(pdf.index) for c, v in made.items()}})

    types = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} {t}" for c, t in fields.items())])
    return df.select(*keys, *arrays).mapInPandas(run, types)


# ---- masks (pixels above 0 are on)


def resized_masks(df: DataFrame, keys: list[str], pixels: str, shape: Shape, radius: int = 1) -> DataFrame:
    """keys, grown, shrunk: the mask by ``radius`` steps to four neighbours more and less; beyond the border
    all is off for growing and on for shrinking."""
    return per_row(df, keys, [pixels], {"grown": "array<boolean>", "shrunk": "array<boolean>"}, lambda a: (image.dilate(a.reshape(shape) > 0, radius), image.erode(a.reshape(shape) > 0, radius)))


def large_regions(df: DataFrame, keys: list[str], pixels: str, shape: Shape, least: int) -> DataFrame:
    """keys, kept: the mask without regions (of four neighbours) of fewer than ``least`` pixels, closed by 3 x 3.
    For stacks larger than a task see regions.label_regions()."""
    return per_row(df, keys, [pixels], {"kept": "array<boolean>"}, lambda a: (image.keep_large(a.reshape(shape) > 0, least),))


def ring_regions(df: DataFrame, keys: list[str], pixels: str, shape: Shape, centre: tuple[float, float], least: int, shrink: int = 0) -> DataFrame:
    """keys, rings, radii: each pixel's region, numbered from 0 by mean distance from the centre (-1: off or in
    a region of fewer than ``least`` pixels), and these distances. Equal ones go in reading order."""

    def f(a):
        numbers, radii = image.components_by_radius(a.reshape(shape) > 0, *centre, least, shrink)
        return numbers, radii

    return per_row(df, keys, [pixels], {"rings": "array<long>", "radii": "array<double>"}, f)


def corner_marks(df: DataFrame, keys: list[str], pixels: str, shape: Shape, threshold: float, area: int, heights: tuple[int, int], widths: tuple[int, int]) -> DataFrame:
    """keys, corner (tl, tr, bl, br), x, y: centroids of bright regions of fitting size by the quarter of the
    frame they lie in; of several in one quarter the last one in reading order."""

    def f(a):
        m = image.marks(a.reshape(shape), threshold, area, heights, widths)
        return ([{"corner": c, "x": float(x), "y": float(y)} for c, (x, y) in sorted(m.items())],)

    rows = per_row(df, keys, [pixels], {"marks": "array<struct<corner:string,x:double,y:double>>"}, f)
    return rows.select(*keys, F.inline("marks"))


def distances_inside(df: DataFrame, keys: list[str], pixels: str, source: str, shape: Shape) -> DataFrame:
    """keys, distances: how far each pixel of the mask is from pixel ``source`` (an array of its row and
    column) over eight neighbours inside the mask; NULL off it and where it can't be reached."""

    def f(a, s):
        g = image.geodesic(a.reshape(shape) > 0, (int(s[0]), int(s[1])))
        return (np.where(np.isfinite(g), g, np.nan),)

    return per_row(df, keys, [pixels, source], {"distances": "array<double>"}, f)


def seams(df: DataFrame, keys: list[str], pixels: str, shape: Shape, centre: tuple[float, float], r0: float, r1: float, rays: int = 720, taps: int = 20) -> DataFrame:
    """keys, azimuth: where the fewest bands end along the rays of a window of ``taps`` rays; the first one of
    equal ones, counted from azimuth 0."""
    return per_row(df, keys, [pixels], {"azimuth": "double"}, lambda a: (walk.seam_azimuth(a.reshape(shape) > 0, *centre, r0, r1, rays, taps),))


# ---- filters and sampling


def box_contrasts(df: DataFrame, keys: list[str], pixels: str, shape: Shape, half_height: int, half_width: int, surround: int) -> DataFrame:
    """keys, contrast: for each pixel the mean of its box less that of the frame around the box; borders are
    continued by their last pixels."""
    return per_row(df, keys, [pixels], {"contrast": "array<double>"}, lambda a: (image.box_match(a.reshape(shape), half_height, half_width, surround),))


def gradients(df: DataFrame, keys: list[str], pixels: str, shape: Shape) -> DataFrame:
    """keys, gradient: magnitudes by Sobel's weights, borders continued."""
    return per_row(df, keys, [pixels], {"gradient": "array<double>"}, lambda a: (image.sobel(a.reshape(shape)),))


def bicubic_samples(df: DataFrame, keys: list[str], pixels: str, shape: Shape, y: str, x: str) -> DataFrame:
    """keys, samples: cubic convolution at the places of the arrays ``y`` and ``x``; borders continued."""
    return per_row(df, keys, [pixels, y, x], {"samples": "array<double>"}, lambda a, p, q: (image.bicubic(a.reshape(shape), q, p),))


def warped(df: DataFrame, keys: list[str], pixels: str, shape: Shape, dy: str, dx: str) -> DataFrame:
    """keys, pixels: read bilinearly at each place moved by the fields ``dy`` and ``dx``, held at borders."""
    return per_row(df, keys, [pixels, dy, dx], {"pixels": "array<double>"}, lambda a, p, q: (image.warp(a.reshape(shape), p.reshape(shape), q.reshape(shape)),))


def enlarged(df: DataFrame, keys: list[str], pixels: str, shape: Shape, to: Shape) -> DataFrame:
    """keys, pixels: bilinear at the new size, pixel centres aligned, borders held."""
    return per_row(df, keys, [pixels], {"pixels": "array<double>"}, lambda a: (image.resize(a.reshape(shape), *to),))


def dense_fields(df: DataFrame, keys: list[str], shifts: str, grid: int, to: Shape, smooth: float) -> DataFrame:
    """keys, dy, dx: fields of the size ``to`` from the shifts (y and x in turn) of grid x grid blocks."""
    return per_row(df, keys, [shifts], {"dy": "array<double>", "dx": "array<double>"}, lambda s: image.dense_field(s.reshape(-1, 2), grid, *to, smooth))


def embeddings(df: DataFrame, keys: list[str], pixels: str, shape: Shape, size: int = 32) -> DataFrame:
    """keys, embedding: gradients at ``size`` x ``size``, of mean 0 and length 1 (all 0 for a flat frame), so
    that products are correlations."""
    return per_row(df, keys, [pixels], {"embedding": "array<double>"}, lambda a: (image.embedding(a.reshape(shape), size),))


def high_frequencies(df: DataFrame, keys: list[str], pixels: str, shape: Shape, top: float = 0.25) -> DataFrame:
    """keys, share: of the spectrum's energy beyond the ``top`` of its frequencies; NULL without energy."""
    return per_row(df, keys, [pixels], {"share": "double"}, lambda a: (image.high_frequency_share(a.reshape(shape), top),))


# ---- pairs of frames


def orientations(df: DataFrame, keys: list[str], a: str, b: str, shape: Shape) -> DataFrame:
    """keys, turns, mirror, score: the quarter turns of ``b``, and whether mirrored, that look most like ``a``;
    of equal ones the fewest turns unmirrored. Frames are square."""
    return per_row(df, keys, [a, b], {"turns": "int", "mirror": "boolean", "score": "double"}, lambda p, q: image.best_orientation(p.reshape(shape), q.reshape(shape)))


def block_shifts(df: DataFrame, keys: list[str], a: str, b: str, shape: Shape, grid: int, limit: int) -> DataFrame:
    """keys, y, x, dy, dx: how far ``b`` lies off ``a`` in each of grid x grid blocks, within ``limit``."""

    def f(p, q):
        at, shift = image.block_displacements(p.reshape(shape), q.reshape(shape), grid, limit)
        return ([dict(zip(("y", "x", "dy", "dx"), map(float, (*u, *v)), strict=True)) for u, v in zip(at, shift, strict=True)],)

    rows = per_row(df, keys, [a, b], {"blocks": "array<struct<y:double,x:double,dy:double,dx:double>>"}, f)
    return rows.select(*keys, F.inline("blocks"))


def circular_peaks(df: DataFrame, keys: list[str], a: str, b: str, shape: Shape) -> DataFrame:
    """keys, peak: the highest correlation of ``a`` with ``b`` rolled both ways."""
    return per_row(df, keys, [a, b], {"peak": "double"}, lambda p, q: (signal.ncc_peak(p.reshape(shape), q.reshape(shape)),))


# ---- series


def best_rolls(df: DataFrame, keys: list[str], a: str, b: str, limit: int | None = None) -> DataFrame:
    """keys, shift: by how many samples, within ``limit``, ``b`` is to be rolled to agree best with ``a``."""
    return per_row(df, keys, [a, b], {"shift": "int"}, lambda p, q: (signal.circular_shift(p, q, limit),))


def separated_peaks(df: DataFrame, keys: list[str], scores: str, k: int, apart: float, period: float) -> DataFrame:
    """keys, places: up to ``k`` places of the largest scores in size, best first, none nearer to a better one
    than ``apart`` on a circle of ``period`` samples; of equal scores the first place."""
    return per_row(df, keys, [scores], {"places": "array<long>"}, lambda a: (list(map(int, signal.top_separated(a, np.arange(float(len(a))), k, apart, period))),))


def fourier_fits(df: DataFrame, keys: list[str], azimuths: str, values: str, harmonics: int, rounds: int = 5) -> DataFrame:
    """keys, coefficients: constant, then cosine and sine of each harmonic, outliers left out round by round."""
    return per_row(df, keys, [azimuths, values], {"coefficients": "array<double>"}, lambda t, v: (signal.fourier_fit(t, v, harmonics, rounds),))


def undone_reading(df: DataFrame, keys: list[str], places: str, values: str, n: int, ridge: float = 0.01) -> DataFrame:
    """keys, samples: the series of ``n`` samples that gives ``values`` when read linearly at ``places``, in
    least squares, bends weighed by ``ridge``."""
    return per_row(df, keys, [places, values], {"samples": "array<double>"}, lambda u, v: (signal.invert_lerp(u, v, n, ridge),))


def ring_tracks(df: DataFrame, keys: list[str], candidates: str, rays: int, start: int, seed: float, jump: float) -> DataFrame:
    """keys, radii: round all rays from ray ``start``, the candidate nearest to the last radius taken (``seed`` at
    first), none where that is more than ``jump`` away; the first of equally near ones. ``candidates``
    holds as many for each ray, ray by ray."""
    return per_row(df, keys, [candidates], {"radii": "array<double>"}, lambda c: (walk.ring_track(list(c.reshape(rays, -1)), start, seed, jump),))


def kept_by_spacing(df: DataFrame, keys: list[str], radii: str, lengths: str, apart: float) -> DataFrame:
    """keys, kept: places of the walks that stay if, in order of radius, one nearer than ``apart`` to the last
    kept one replaces it where longer and goes where not."""
    return per_row(df, keys, [radii, lengths], {"kept": "array<long>"}, lambda r, n: (list(map(int, walk.dedup_by_spacing(r, n, apart))),))


def split_runs(runs: DataFrame, lo: str, hi: str, thickness: Column, least: float = 1.7) -> DataFrame:
    """Runs that hold two usual thicknesses or more (``least`` of them at any rate) cut into as many equal parts
    as they hold, rounded half to even: the runs' columns, with lo and hi of a part, and part from 0. NULL
    or zero thickness leaves a run whole."""
    length = F.col(hi) - F.col(lo)
    n = rint(F.try_divide(length, thickness))
    parts = F.when((n >= 2) & (length >= least * thickness), n).otherwise(F.lit(1.0))
    rows = runs.withColumn("_parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts").cast("int") - 1)))
    step = length / F.col("_parts")
    return rows.withColumns({lo: F.col(lo) + F.col("part") * step, hi: F.col(lo) + (F.col("part") + 1) * step}).drop("_parts")
