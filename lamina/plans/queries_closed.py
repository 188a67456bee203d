"""Queries of frame operators whose result is known in closed form: turned and rolled images, affine fields,
readings undone. Their SQL states it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lamina.kernels import signal
from lamina.operators import kernel_ops as k
from lamina.operators import frames as fr
from lamina.plans.queries_image import _SOBEL, PIXELS, SIDE, frames, numbers, top_and_total
from lamina.plans.queries_native import r6
from lamina.plans.registry import query, table


@query("affine_fields", """
SELECT vec_id, round(e[1], 6) AS y0, round(e[2], 6) AS yy, round(e[3], 6) AS yx, round(e[4], 6) AS x0 FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)""")  # fmt: skip
def affine_fields(spark, d):
    """Displacements that are affine give back their coefficients, one gross error aside."""
    y, x = np.mgrid[:8, :8]
    places = np.column_stack([y.ravel(), x.ravel()]).astype(float)

    def f(a, _):
        field = np.column_stack([a[0] + places @ a[1:3], a[3] + places @ a[4:6]])
        c = signal.affine_fit(places, field)
        return {"y0": c[0, 0], "yy": c[1, 0], "yx": c[2, 0], "x0": c[0, 1]}

    return numbers(spark, d, f, ["y0", "yy", "yx", "x0"], shape=None)


@query("inverted_lerp", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(CAST(embedding[33] AS DOUBLE), 5) AS middle, round(CAST(embedding[64] AS DOUBLE), 5) AS last FROM embeddings""")  # fmt: skip
def inverted_lerp(spark, d):
    """A signal read at every half place comes back."""
    e = frames(spark, d)
    read = F.transform(F.sequence(F.lit(0), F.lit(126)), lambda k: (F.get("a", F.floor(k / 2).cast("int")) + F.get("a", F.ceil(k / 2).cast("int"))) / 2)
    e = e.select("vec_id", F.array(*[F.lit(k / 2) for k in range(127)]).alias("u"), read.alias("v"))
    out = fr.undone_reading(e, ["vec_id"], "u", "v", 64, ridge=0.0)
    return out.select("vec_id", *[F.round(F.get("samples", F.lit(k)), 5).alias(n) for k, n in ((0, "first"), (32, "middle"), (63, "last"))])


@query("turned_images", """
SELECT vec_id, CAST((4 - vec_id % 4) % 4 AS DOUBLE) AS turns, 0.0 AS mirror, 1.0 AS dy, -2.0 AS dx, 1.0 AS score FROM embeddings""")  # fmt: skip
def turned_images(spark, d):
    """The turn that undoes a turn, and the block shift that undoes a roll."""
    i, j = (lambda p: F.floor(p / 8)), (lambda p: p % 8)
    at = lambda row, col: F.get("a", (row * 8 + col).cast("int"))
    turn = F.col("vec_id") % 4
    turned = lambda _, p: F.when(turn == 0, F.get("a", p)).when(turn == 1, at(j(p), 7 - i(p))).when(turn == 2, at(7 - i(p), 7 - j(p))).otherwise(at(7 - j(p), i(p)))
    rolled = lambda _, p: at(F.pmod(i(p) - 1, F.lit(8)), F.pmod(j(p) + 2, F.lit(8)))
    e = frames(spark, d).withColumns({"b": F.transform("a", turned), "c": F.transform("a", rolled)})
    turns = fr.orientations(e, ["vec_id"], "a", "b", SIDE).select("vec_id", F.col("turns").cast("double").alias("turns"), F.col("mirror").cast("double").alias("mirror"), "score")
    shift = fr.block_shifts(e, ["vec_id"], "a", "c", SIDE, 1, 3).select("vec_id", "dy", "dx")
    return r6(turns.join(shift, "vec_id"), "dy", "dx", "score")


@query("distances_inside", """
SELECT vec_id, round(sum(greatest(dy, dx) + (sqrt(2) - 1) * least(dy, dx)), 6) AS total, round(max(greatest(dy, dx) + (sqrt(2) - 1) * least(dy, dx)), 6) AS furthest
FROM (SELECT vec_id, abs(i // 8 - vec_id % 8) AS dy, abs(i % 8 - vec_id // 8 % 8) AS dx FROM (SELECT vec_id, unnest(range(64)) AS i FROM embeddings)) GROUP BY vec_id""")  # fmt: skip
def distances_inside(spark, d):
    """Over eight neighbours in an open square."""
    e = table(spark, d, "embeddings").select("vec_id", F.array_repeat(F.lit(1.0), 64).alias("a"), F.array((F.col("vec_id") % 8).cast("double"), (F.floor(F.col("vec_id") / 8) % 8).cast("double")).alias("s"))
    out = fr.distances_inside(e, ["vec_id"], "a", "s", SIDE)
    return r6(out.select("vec_id", F.aggregate("distances", F.lit(0.0), lambda a, v: a + v).alias("total"), F.array_max("distances").alias("furthest")), "total", "furthest")


@query("embedded_images", f"WITH c AS ({PIXELS}), {_SOBEL} SELECT a.vec_id, round(corr(a.g, b.g), 6) AS likeness FROM s a JOIN s b ON b.vec_id = a.vec_id + 1 AND b.i = a.i GROUP BY a.vec_id")
def embedded_images(spark, d):
    """The product of two images' embeddings is the correlation of their gradients."""
    e = fr.embeddings(frames(spark, d), ["vec_id"], "a", SIDE, 8)
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return r6(both.select("vec_id", F.aggregate(F.zip_with("embedding", "b", lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v).alias("likeness")), "likeness")


@query("enlarged", f"""
WITH c AS ({PIXELS}), g AS (SELECT y, x, least(greatest((y + 0.5) / 2 - 0.5, 0.0), 7.0) AS cy, least(greatest((x + 0.5) / 2 - 0.5, 0.0), 7.0) AS cx FROM (SELECT unnest(range(16)) AS y) CROSS JOIN (SELECT unnest(range(16)) AS x)),
o AS (SELECT a.dy, b.dx FROM (SELECT unnest([0, 1]) AS dy) a CROSS JOIN (SELECT unnest([0, 1]) AS dx) b),
n AS (SELECT c.vec_id, g.y, g.x, sum(c.v * (CASE dy WHEN 1 THEN cy - least(floor(cy), 6) ELSE 1 - cy + least(floor(cy), 6) END) * (CASE dx WHEN 1 THEN cx - least(floor(cx), 6) ELSE 1 - cx + least(floor(cx), 6) END)) AS s
  FROM g CROSS JOIN o JOIN c ON c.y = least(floor(cy), 6) + dy AND c.x = least(floor(cx), 6) + dx GROUP BY c.vec_id, g.y, g.x)
SELECT vec_id, round(max(s), 6) AS top, round(sum(s), 6) AS total, round(max(e), 6) AS level FROM n JOIN (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS e FROM embeddings) USING (vec_id) GROUP BY vec_id""")  # fmt: skip
def enlarged(spark, d):
    """Twice the size; and a field of equal block shifts is that shift everywhere."""
    e = frames(spark, d)
    big = fr.enlarged(e, ["vec_id"], "a", SIDE, (16, 16)).select("vec_id", *top_and_total("pixels"))
    field = fr.dense_fields(e.select("vec_id", F.array_repeat(F.get("a", F.lit(0)), 8).alias("s")), ["vec_id"], "s", 2, (12, 12), 1.0)
    level = field.select("vec_id", ((F.array_max("dy") + F.array_min("dx")) / 2).alias("level"))
    return r6(big.join(level, "vec_id"), "top", "total", "level")
