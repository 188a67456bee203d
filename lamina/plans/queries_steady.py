"""Queries of frames paired, matched and scored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lamina.functions.semantics import ordered
from lamina.kernels import steady
from lamina.operators import steady as op
from lamina.plans.queries_image import PIXELS, SIDE, numbers
from lamina.plans.queries_native import events, r6
from lamina.plans.registry import query, table


@query("matched_values", f"""
WITH c AS ({PIXELS}), a AS (SELECT vec_id, v, rank() OVER (PARTITION BY vec_id ORDER BY v) AS r, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS i, count(*) OVER (PARTITION BY vec_id, v) AS n FROM c),
b AS (SELECT vec_id, v AS w, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS i FROM c)
SELECT a.vec_id, round(avg(b.w), 6) AS mean, round(max(b.w) - min(b.w), 6) AS span FROM a JOIN b ON b.vec_id = a.vec_id + 1 AND b.i = a.r + a.n - 1 GROUP BY a.vec_id""")  # fmt: skip
def matched_values(spark, d):
    """A vector's values replaced by those of the same rank in the next one."""

    def f(a, b):
        m = steady.match_histogram(a, b)
        return {"mean": m.mean(), "span": float(np.ptp(m))}

    return numbers(spark, d, f, ["mean", "span"], shape=SIDE, pair=True)


@query("variant_frames", "SELECT vec_id, 1e0 AS grad_corr, 1e0 AS ms_ssim, 0e0 AS mse FROM embeddings")
def variant_frames(spark, d):
    """A picture against itself, affine alignment and matching of histograms included."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    return op.variant_frames(e.withColumn("b", F.col("a")), ["vec_id"], "a", "b", SIDE, grid=1, rounds=1, crop=0.0).select("vec_id", *[F.round(c, 4).alias(c) for c in ("grad_corr", "ms_ssim", "mse")])


@query("variant_summary", """
SELECT event_type, count(*) AS pairs, round(avg(value / 2), 6) AS half, round(avg(value), 6) AS mse, round(-10 * log10(avg(value)), 6) AS psnr FROM events GROUP BY event_type""")  # fmt: skip
def variant_summary(spark, d):
    scores = events(spark, d).withColumn("half", F.col("value") / 2)
    return r6(op.variant_summary(scores, ["event_type"], ["half"], "value"), "half", "mse", "psnr")


@query("evenly_paired", """
WITH e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i FROM events),
t AS (SELECT * FROM (SELECT user_id, event_type, i, value FROM e)), n AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL),
g AS (SELECT n.user_id, n.event_type, u.i, n.n FROM n CROSS JOIN (SELECT unnest(range(12)) AS i) u WHERE u.i < 10)
SELECT g.user_id, g.event_type, g.i, CAST(round_even(g.i * (g.n - 1) / 11.0, 0) AS BIGINT) AS true_i, t.value AS true_value
FROM g JOIN t ON t.user_id = g.user_id AND t.event_type = g.event_type AND t.i = CAST(round_even(g.i * (g.n - 1) / 11.0, 0) AS BIGINT)""")  # fmt: skip
def evenly_paired(spark, d):
    """Twelve guesses for each user's events of a type, the last two left out."""
    keys = ["user_id", "event_type"]
    truths = table(spark, d, "events").withColumn("i", (F.row_number().over(ordered(keys, "ts", "event_id")) - 1).cast("long")).select(*keys, "i", "value")
    guesses = truths.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("i"))
    return op.evenly_paired(guesses, truths, keys, "i", dropped=2)
