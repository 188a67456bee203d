"""Searches of several parameters in levels: a grid of candidates for each key, the best one, a finer
grid around it. A level is one job over rows of (key, candidate); what scores them is the caller's."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.kernels import image, signal
from lamina.sources.scratch import settle


def search_levels(things: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float, float]], score: Callable[[DataFrame], DataFrame], levels: int = 3, finer: int = 4) -> DataFrame:
    """keys, the parameters and score: for each key the candidate of the highest score, of equal ones the
    one whose parameters come first in order.

    The first grid takes each parameter from lo to hi by its step (``ranges``); every next one goes one step
    to either side of the best by a step ``finer`` times smaller, not beyond lo and hi. ``score`` gets
    keys and parameters and returns them with a column score; candidates whose score is NULL or NaN,
    or that it leaves out, lose. Keys without a scored candidate give no row. Steps are counted in whole
    numbers from lo, so a grid's points don't drift."""
    names = list(ranges)
    here = things.select(*keys).distinct()
    best: DataFrame | None = None
    for level in range(levels):
        grid = here if best is None else best.select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
        for n, (lo, hi, step) in ranges.items():
            fine = step / finer**level
            last = int(np.floor((hi - lo) / fine + 1e-9))
            at = F.sequence(F.lit(0), F.lit(last)) if best is None else F.sequence(F.greatest(F.rint((F.col(f"_{n}") - lo) / fine).cast("int") - finer, F.lit(0)), F.least(F.rint((F.col(f"_{n}") - lo) / fine).cast("int") + finer, F.lit(last)))
            grid = grid.withColumn(f"{n}_at", F.explode(at)).withColumn(n, lo + F.col(f"{n}_at") * fine)
        scored = score(grid.select(*keys, *names))
        ok = scored.where(F.col("score").isNotNull() & ~F.isnan(F.col("score")))
        first = F.struct((-F.col("score")).alias("_s"), *names)
        best = settle(ok.groupBy(*keys).agg(F.min(first).alias("_b")).select(*keys, *[F.col(f"_b.{n}").alias(n) for n in names], (-F.col("_b._s")).alias("score")))
    return best


def align_scales(pairs: DataFrame, keys: list[str], a: str, b: str, shape: tuple[int, int], lo: float = 0.85, hi: float = 1.25, step: float = 0.05, levels: int = 3, finer: int = 4) -> DataFrame:
    """keys, sx, sy, score: by which factors along x and y image ``b`` is to be enlarged to look most like
    image ``a``, wherever it then lies; score is the highest circular correlation. One image of each
    for a key; images travel to their candidates' tasks by a join on the key. Null images or pixels
    give no row."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    names = list(keys)

    def run(parts):
        for pdf in parts:
            out = []
            for p, q, sx, sy in zip(pdf[a], pdf[b], pdf["sx"], pdf["sy"], strict=True):
                p, q = np.asarray(p, float).reshape(shape), np.asarray(q, float).reshape(shape)
                # read at places closer together: enlarged about the middle
                cy, cx = (shape[0] - 1) / 2, (shape[1] - 1) / 2
                moved = image.bilinear(q, np.clip(cx + (x - cx) / sx, 0, shape[1] - 1), np.clip(cy + (y - cy) / sy, 0, shape[0] - 1))
                out.append(signal.ncc_peak(p, moved))
            yield pd.DataFrame({**{k: pdf[k] for k in names}, "sx": pdf["sx"], "sy": pdf["sy"], "score": np.array(out, float)})

    sound = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.exists(F.concat(a, b), lambda v: v.isNull() | F.isnan(v)))
    types = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def score(grid: DataFrame) -> DataFrame:
        return grid.join(sound.select(*keys, a, b), keys).mapInPandas(run, f"{types}, sx double, sy double, score double")

    return search_levels(sound, keys, {"sx": (lo, hi, step), "sy": (lo, hi, step)}, score, levels, finer)
