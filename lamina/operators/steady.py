"""Frames held still, cut and scored. Frames are rows with their pixels in an array; a group is one
reel (or block of it) at the resolution it is matched at and must fit a task. Empty groups give no
rows; null pixels are read as NaN, and frames that hold one get NaN shifts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.semantics import rint
from lamina.kernels import image, steady
from lamina.operators.kernel_ops import _types, apply, pair_numbers


def _stack(column: pd.Series, shape: tuple[int, int]) -> np.ndarray:
    return np.stack([np.asarray(v, float).reshape(shape) for v in column])


def stabilise(df: DataFrame, keys: list[str], order: str, pixels: str, shape: tuple[int, int], **how) -> DataFrame:
    """keys, order, dy, dx, angle at which each frame is to be read, and the box (top, bottom, left,
    right) that all frames then fill."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order)
        shifts, box = steady.stabilise(_stack(p[pixels], shape), **how)
        out = pd.DataFrame(shifts, columns=["dy", "dx", "angle"])
        out.insert(0, order, p[order].to_numpy())
        return out.assign(top=box[0], bottom=box[1], left=box[2], right=box[3])

    return apply(df.select(*keys, order, pixels), keys, f"{_types(df, [order])}, dy double, dx double, angle double, top int, bottom int, left int, right int", run)


def locked_shifts(df: DataFrame, keys: list[str], order: str, pixels: str, shape: tuple[int, int], slow: bool = False, **how) -> DataFrame:
    """keys, order, dy, dx of edge images against their neighbours' medians, or (``slow``) the sway of
    blurred frames against the median of all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order)
        out = pd.DataFrame((steady.lock_slow if slow else steady.lock_local)(_stack(p[pixels], shape), **how), columns=["dy", "dx"])
        out.insert(0, order, p[order].to_numpy())
        return out

    return apply(df.select(*keys, order, pixels), keys, f"{_types(df, [order])}, dy double, dx double", run)


def border_shifts(df: DataFrame, keys: list[str], order: str, pixels: str, shape: tuple[int, int], band: float = 0.1, limit: int = 40) -> DataFrame:
    """keys, order and how far the left, right, top and bottom border lie from their medians."""
    names = ["left", "right", "top", "bottom"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order)
        out = pd.DataFrame(steady.border_shifts(_stack(p[pixels], shape), band, limit), columns=names)
        out.insert(0, order, p[order].to_numpy())
        return out

    return apply(df.select(*keys, order, pixels), keys, f"{_types(df, [order])}, " + ", ".join(f"{n} double" for n in names), run)


def aperture_edges(df: DataFrame, keys: list[str], pixels: str, shape: tuple[int, int], guess: tuple[float, float], half: float) -> DataFrame:
    """keys, left, right: the aperture's edges in each frame. Nothing is shuffled."""
    return pair_numbers(df.withColumn("_same", F.col(pixels)), keys, pixels, "_same", shape, lambda a, _: dict(zip(("left", "right"), steady.aperture_edges(a, guess, half), strict=True)), ["left", "right"])


def variant_frames(df: DataFrame, keys: list[str], truth: str, guess: str, shape: tuple[int, int], grid: int = 5, rounds: int = 3, crop: float = 0.05) -> DataFrame:
    """keys, grad_corr, ms_ssim, mse of each pair after affine alignment, a crop of the interior and
    matching of histograms. Nothing is shuffled."""

    def f(t: np.ndarray, g: np.ndarray) -> dict[str, float]:
        a, b = (image.centred_crop(x, crop) for x in steady.align_affine(t, g, grid, rounds))
        b = steady.match_histogram(b, a)
        return {"grad_corr": image.gradient_correlation(a, b), "ms_ssim": image.multi_scale_ssim(a, b), "mse": float(((a - b) ** 2).mean())}

    return pair_numbers(df, keys, truth, guess, shape, f, ["grad_corr", "ms_ssim", "mse"])


def variant_summary(scores: DataFrame, keys: list[str], means: list[str], mse: str = "mse") -> DataFrame:
    """keys, pairs, the means, mse and the PSNR of the mean error (not the mean of PSNRs; infinite
    without error). Missing scores count in no mean."""
    error = F.avg(mse)
    psnr = F.when(error > 0, -10 * F.log10(error)).when(error == 0, F.lit(float("inf")))
    return scores.groupBy(*keys).agg(F.count("*").alias("pairs"), *[F.avg(m).alias(m) for m in means], error.alias("mse"), psnr.alias("psnr"))


def evenly_paired(guesses: DataFrame, truths: DataFrame, keys: list[str], index: str, dropped: int = 0) -> DataFrame:
    """Rows numbered from 0 in both, the guesses spread evenly over the truths (rounded half to even),
    the last ``dropped`` guesses left out after that: the guesses' columns and those of their truth
    with true_ in front."""
    counts = [d.groupBy(*keys).agg((F.max(index) + 1).alias(n)) for d, n in ((guesses, "_n"), (truths, "_m"))]
    place: Column = F.when(F.col("_n") > 1, rint(F.col(index) * (F.col("_m") - 1) / (F.col("_n") - 1))).otherwise(F.lit(0.0))
    g = guesses.join(counts[0], keys).join(counts[1], keys).where(F.col(index) < F.col("_n") - dropped)
    g = g.withColumn(f"true_{index}", place.cast(truths.schema[index].dataType))
    t = truths.select(*keys, *[F.col(c).alias(f"true_{c}") for c in truths.columns if c not in keys])
    return g.join(t, [*keys, f"true_{index}"]).drop("_n", "_m")
