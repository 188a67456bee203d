"""Winding identity as a stream: z is event order, the tracks of a roll are its state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamina.kernels.walk import Tracker

OUT = "roll long, z int, walk_id int, track_id int"


def track_stream(profiles: DataFrame, near: float) -> DataFrame:
    """(roll, z, walk_id, r array) of a stream, or of a batch in micro-batches of whole slices, to
    (roll, z, walk_id, track_id). Slices of a roll come in rising z; one that falls behind is left out,
    as its windings have been numbered past. The state is a profile for each track."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, last = Tracker(near), -(2**31)
        if state.exists:
            known, last = pickle.loads(state.get[0])
            tracker.restore(known)
        rows = []
        for z, part in pd.concat(list(parts)).sort_values(["z", "walk_id"]).groupby("z"):
            if z > last:
                ids = tracker.step(int(z), [np.array([np.nan if v is None else v for v in r], float) for r in part["r"]])
                rows += [(key[0], int(z), int(w), i) for w, i in zip(part["walk_id"], ids, strict=True)]
                last = z
        state.update((pickle.dumps((tracker.state(), last)),))
        yield pd.DataFrame(rows, columns=["roll", "z", "walk_id", "track_id"])

    return profiles.select(F.col("roll").cast("long").alias("roll"), "z", "walk_id", "r").groupBy("roll").applyInPandasWithState(run, OUT, "tracker binary", "append", GroupStateTimeout.NoTimeout)


def gap_sessions(events: DataFrame, keys: list[str], at: str, gap: str, watermark: str) -> DataFrame:
    """Runs of a stream of detections: sessions that end after ``gap`` without one, closed by a
    watermark: keys, lo, hi, n."""
    w = F.session_window(F.col(at), gap)
    s = events.withWatermark(at, watermark).groupBy(*keys, w).agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n"))
    return s.select(*keys, "lo", "hi", "n")
