"""Kernels applied to groups: each group is one key's bounded array data, moved by Arrow.

``apply`` takes any function of a group's DataFrame; the named operators below fix inputs and
outputs. A group must fit a task: a profile, a pair of images, a slice; not a whole roll of pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.semantics import ordered
from lamina.kernels import image, signal

#: Rows of a batch that goes back to Spark.
BATCH = 1 << 16


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def apply(df: DataFrame, keys: list[str], out: str, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``f`` of each group, its keys put in front of the columns ``out`` declares."""
    names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = f(pdf)
        for i, k in enumerate(names):
            r.insert(i, k, pdf[k].iloc[0])
        return r

    return df.groupBy(*keys).applyInPandas(run, f"{_types(df, keys)}, {out}")


def series_map(df: DataFrame, keys: list[str], order: str, value: str, f: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """A series turned into one of the same length: keys, order, name."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order)
        return pd.DataFrame({order: p[order].to_numpy(), name: np.asarray(f(p[value].to_numpy(float)), float)})

    return apply(df.select(*keys, order, value), keys, f"{_types(df, [order])}, {name} double", run)


def series_numbers(df: DataFrame, keys: list[str], order: str, value: str, f: Callable[[np.ndarray], dict[str, float]], names: list[str]) -> DataFrame:
    """Numbers of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([f(pdf.sort_values(order)[value].to_numpy(float))], columns=names).astype(float)

    return apply(df.select(*keys, order, value), keys, ", ".join(f"{n} double" for n in names), run)


def series_places(df: DataFrame, keys: list[str], order: str, value: str, f: Callable[[np.ndarray], np.ndarray], name: str = "at") -> DataFrame:
    """A varying number of places of each series: keys, k, name. Spark sorts the rows, on disk if need be; of
    a series only the samples are held, at 8 bytes each."""
    names = list(keys)

    def places(own: list[pa.Array], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a = np.concatenate(parts)
        parts.clear()
        at = np.asarray(f(a), float)
        for i in range(0, len(at), BATCH):
            n = min(BATCH, len(at) - i)
            same = pa.array(np.zeros(n, np.int64))
            yield pa.record_batch([*[c.take(same) for c in own], pa.array(np.arange(i, i + n, dtype=np.int64)), pa.array(at[i : i + n], pa.float64())], [*names, "k", name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []
        for t in batches:
            v = t.column("_v").to_numpy(zero_copy_only=False)
            new = t.column("_new").to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(new).tolist(), len(v)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j and new[i]:
                    if own is not None:
                        yield from places(own, parts)
                    own = [t.column(k).slice(i, 1) for k in names]
                if i < j:
                    parts.append(v[i:j].copy())
        if own is not None:
            yield from places(own, parts)

    by = ordered(keys, F.col(order).asc_nulls_last())
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), (F.row_number().over(by) == 1).alias("_new"))
    return rows.mapInArrow(run, f"{_types(df, keys)}, k long, {name} double")


def pair_numbers(df: DataFrame, keys: list[str], a: str, b: str, shape: tuple[int, int] | None, f: Callable[[np.ndarray, np.ndarray], dict[str, float]], names: list[str]) -> DataFrame:
    """Numbers of two arrays of each row, as images of ``shape`` if given. Rows are independent, so
    nothing is shuffled."""
    kept = list(keys)

    def run(parts):
        for pdf in parts:
            out = []
            for x, y in zip(pdf[a], pdf[b], strict=True):
                p, q = np.asarray(x, float), np.asarray(y, float)
                out.append(f(p.reshape(shape), q.reshape(shape)) if shape else f(p, q))
            r = pd.DataFrame(out, columns=names).astype(float)
            for i, k in enumerate(kept):
                r.insert(i, k, pdf[k].to_numpy())
            yield r

    return df.select(*keys, a, b).mapInPandas(run, f"{_types(df, keys)}, " + ", ".join(f"{n} double" for n in names))


# ---- named operators
#
# A group without rows gives none. NULL samples reach kernels as NaN; order must not repeat in a key,
# or equal places stand in no fixed order.


def gaussian_smooth(df, keys, order, value, sigma, mode="nearest"):
    """keys, order, smooth: a Gaussian of ``sigma`` samples that ends at four of them. A NULL or NaN sample
    makes NaN of all that it would weigh in."""
    return series_map(df, keys, order, value, lambda a: signal.convolve1d(a, signal.gaussian_taps(sigma), mode), "smooth")


def fill_and_smooth(df, keys, order, value, sigma, limit=4.0):
    """keys, order, smooth: missing samples filled linearly, the ends held; what lies further than ``limit``
    scaled MADs from the median of nine filled likewise; a Gaussian. All missing: zeros."""
    return series_map(df, keys, order, value, lambda a: signal.fill_and_smooth(a, sigma, limit), "smooth")


def circular_fill(df, keys, order, value, sigma):
    """keys, order, smooth: missing samples filled linearly round the circle, then a circular Gaussian (none for
    ``sigma`` 0). All missing: zeros."""
    return series_map(df, keys, order, value, lambda a: signal.fill_circular(a, sigma), "smooth")


def bandpass(df, keys, order, value, pitch, width=0.25):
    """keys, order, part: what has periods within ``width`` (a share) of ``pitch``. A NULL or NaN sample makes the
    whole series NaN."""
    return series_map(df, keys, order, value, lambda a: signal.bandpass(a, pitch, width), "part")


def pitch(df, keys, order, value, lo, hi):
    """Autocorrelation pitch, its refinement, and that from the phase; of equal maxima the shortest period. A
    NULL or NaN sample makes all three NaN."""

    def f(a: np.ndarray) -> dict[str, float]:
        p = signal.estimate_pitch(a, lo, hi)
        q = signal.refine_pitch(a, p)
        return {"pitch": p, "refined": q, "phase": signal.phase_pitch(a, q)}

    return series_numbers(df, keys, order, value, f, ["pitch", "refined", "phase"])


def find_peaks(df, keys, order, value, distance=1.0, prominence=0.0):
    """keys, k, at: places of local maxima, a plateau's middle (the left one of two); where two are nearer than
    ``distance`` the higher stays, of equally high ones the first. NULL or NaN samples are never maxima, nor
    are their neighbours; series without maxima give no rows."""
    return series_places(df, keys, order, value, lambda a: signal.peaks(a, distance, prominence))


def cell_bounds(df, keys, order, value, pitch_, how="lock"):
    """Bounds of cells: evenly spaced at the best phase, peaks of the band, or tracked phase."""
    f = {"lock": signal.phase_lock, "peaks": signal.boundaries, "track": signal.tracked_boundaries}[how]
    return series_places(df, keys, order, value, lambda a: f(a, pitch_))


def winding_boundaries(df, keys, radius, smooth=3.0, distance=8.0, share=0.08, per_length=False):
    """keys, k, r: valleys of each group's histogram of radii. Radii are counted in bins of 1 before they are
    grouped, so a group is as large as its largest radius, however many radii there are. NULL, NaN and
    negative radii are left out; a group without valleys gives no rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros(int(pdf["_bin"].max()) + 1)
        h[pdf["_bin"]] = pdf["_n"]
        at = signal.valleys(h, smooth, distance, share, per_length)
        return pd.DataFrame({"k": np.arange(len(at), dtype=np.int64), "r": np.asarray(at, float)})

    r = F.col(radius).cast("double")
    counted = df.where((r >= 0) & ~F.isnan(r)).groupBy(*keys, F.floor(r).alias("_bin")).agg(F.count("*").alias("_n"))
    return apply(counted, keys, "k long, r double", run)


def shift_to_reference(df, keys, a, b, limit):
    """Sub-sample shift of profile b against a and its correlation; NaN at the ends of the range."""
    return pair_numbers(df, keys, a, b, None, lambda p, q: dict(zip(("shift", "corr"), signal.shift1d(p, q, limit), strict=True)), ["shift", "corr"])


def image_shift(df, keys, a, b, shape, limit, sub=True):
    return pair_numbers(df, keys, a, b, shape, lambda p, q: dict(zip(("dy", "dx"), signal.phase_correlation(p, q, limit, sub), strict=True)), ["dy", "dx"])


def image_scores(df, keys, a, b, shape):
    """Gradient correlation, SSIM, the mean over scales, PSNR and mean absolute difference."""

    def f(p: np.ndarray, q: np.ndarray) -> dict[str, float]:
        mse = float(((p - q) ** 2).mean())
        return {"grad_corr": image.gradient_correlation(p, q), "ssim": image.ssim(p, q), "ms_ssim": image.multi_scale_ssim(p, q), "psnr": float("inf") if mse == 0 else float(-10 * np.log10(mse)), "msad": float(np.abs(p - q).mean())}

    return pair_numbers(df, keys, a, b, shape, f, ["grad_corr", "ssim", "ms_ssim", "psnr", "msad"])


def align_sequences(df: DataFrame, keys: list[str], side: str, order: str, vector: str, band: float = 0.1) -> DataFrame:
    """Dynamic time warping of each group's two sequences (side 0 and 1) of vectors: keys, i, j."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.stack(p.sort_values(order)[vector].to_list()).astype(float) if len(p) else np.zeros((0, 1)) for p in (pdf[pdf[side] == s] for s in (0, 1)))
        path = signal.dtw(a, b, band) if len(a) and len(b) else []
        return pd.DataFrame(path, columns=["i", "j"]).astype("int64")

    return apply(df.select(*keys, side, order, vector), keys, "i long, j long", run)


def best_path(df: DataFrame, keys: list[str], step: str, state: str, score: str, penalty: float) -> DataFrame:
    """Viterbi over each group's scores (step, state): keys, step, state."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=step, columns=state, values=score).sort_index().sort_index(axis=1)
        path = signal.viterbi(m.fillna(-1e9).to_numpy(), penalty)
        return pd.DataFrame({step: m.index.to_numpy(), state: m.columns.to_numpy()[path]})

    return apply(df.select(*keys, step, state, score), keys, _types(df, [step, state]), run)


def label_components(df: DataFrame, keys: list[str], row: str, mask: str) -> DataFrame:
    """Components of each group's image of mask rows: keys, label, n, cx, cy."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf.sort_values(row)[mask].to_list()) > 0
        lab, n = image.components(m)
        y, x = np.mgrid[: m.shape[0], : m.shape[1]]
        size = np.bincount(lab.ravel(), minlength=n + 1)[1:]
        cx, cy = (np.bincount(lab.ravel(), v.ravel().astype(float), n + 1)[1:] / np.maximum(size, 1) for v in (x, y))
        return pd.DataFrame({"label": np.arange(1, n + 1), "n": size, "cx": cx, "cy": cy})

    return apply(df.select(*keys, row, mask), keys, "label long, n long, cx double, cy double", run)


def stack_centres(df: DataFrame, keys: list[str], row: str, labels: str) -> DataFrame:
    """The hole's centre of each group's label image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cx, cy = image.centre_of_hole(np.stack(pdf.sort_values(row)[labels].to_list()))
        return pd.DataFrame({"cx": [cx], "cy": [cy]})

    return apply(df.select(*keys, row, labels), keys, "cx double, cy double", run)


def greedy_pairs(pairs: DataFrame, keys: list[str], a: str, b: str, cost: str) -> DataFrame:
    """One-to-one pairs of each group taken by rising cost (ties: a, b)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, kept = set(), set(), []
        for r in pdf.sort_values([cost, a, b])[[a, b, cost]].itertuples(index=False):
            if r[0] not in left and r[1] not in right:
                left.add(r[0])
                right.add(r[1])
                kept.append(tuple(r))
        return pd.DataFrame(kept, columns=[a, b, cost])

    return apply(pairs.select(*keys, a, b, cost), keys, _types(pairs, [a, b, cost]), run)
