"""Queries of Arrow kernels over the driver's tables; SQL where it can state the kernel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lamina.functions import semantics as sem
from lamina.kernels import frames, signal
from lamina.operators import frames as fr
from lamina.operators import kernel_ops as k
from lamina.operators import matching
from lamina.plans import spiral
from lamina.plans.queries_native import CELLS, INDEXED, PAIRS, cells, click_pairs, events, r6
from lamina.plans.registry import query, table

_TAPS, _TAPS2 = signal.gaussian_taps(1.5).tolist(), signal.gaussian_taps(2.0).tolist()
NEXT = "SELECT a.vec_id, i, CAST(a.embedding[i + 1] AS DOUBLE) AS a, CAST(b.embedding[i + 1] AS DOUBLE) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 CROSS JOIN (SELECT unnest(range(64)) AS i)"
_BEND = "CASE WHEN {a} - 2 * {b} + {c} = 0 THEN 0 ELSE least(greatest(0.5 * ({a} - {c}) / ({a} - 2 * {b} + {c}), -1.0), 1.0) END"


def neighbours(spark, d):
    """Each vector beside the next one of the table."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@query("gaussian_smooth", f"""
WITH c AS ({CELLS}), t AS (SELECT unnest(range({len(_TAPS)})) - {len(_TAPS) // 2} AS o, unnest({_TAPS}) AS w)
SELECT c.z, c.col, round(sum(w * n.v), 6) AS smooth FROM c CROSS JOIN t JOIN c n ON n.z = c.z AND n.col = least(greatest(c.col + t.o, 0), 63) GROUP BY c.z, c.col""")  # fmt: skip
def gaussian_smooth(spark, d):
    return r6(k.gaussian_smooth(cells(spark, d), ["z"], "col", "v", 1.5), "smooth")


@query("image_errors", """
WITH p AS (SELECT a.vec_id, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
x AS (SELECT vec_id, CAST(unnest(a) AS DOUBLE) - CAST(unnest(b) AS DOUBLE) AS d FROM p)
SELECT vec_id, round(-10 * log10(avg(d * d)), 5) AS psnr, round(avg(abs(d)), 6) AS msad FROM x GROUP BY vec_id""")  # fmt: skip
def image_errors(spark, d):
    s = k.image_scores(neighbours(spark, d), ["vec_id"], "a", "b", (8, 8))
    return s.select("vec_id", F.round("psnr", 5).alias("psnr"), F.round("msad", 6).alias("msad"))


@query("image_similarity", f"""
WITH n AS ({NEXT}), c AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, a, b FROM n),
t AS (SELECT unnest(range({len(_TAPS)})) - {len(_TAPS) // 2} AS o, unnest({_TAPS}) AS w), k AS (SELECT p.o AS dy, q.o AS dx, p.w * q.w AS w FROM t p CROSS JOIN t q),
l AS (SELECT c.vec_id, c.y, c.x, w, CASE WHEN c.y + dy < 0 THEN -1 - c.y - dy WHEN c.y + dy > 7 THEN 15 - c.y - dy ELSE c.y + dy END AS qy, CASE WHEN c.x + dx < 0 THEN -1 - c.x - dx WHEN c.x + dx > 7 THEN 15 - c.x - dx ELSE c.x + dx END AS qx FROM c CROSS JOIN k),
g AS (SELECT l.vec_id, l.y, l.x, sum(w * q.a) AS ma, sum(w * q.b) AS mb, sum(w * q.a * q.a) AS aa, sum(w * q.b * q.b) AS bb, sum(w * q.a * q.b) AS ab FROM l JOIN c q ON q.vec_id = l.vec_id AND q.y = l.qy AND q.x = l.qx GROUP BY l.vec_id, l.y, l.x),
s AS (SELECT vec_id, avg((2 * ma * mb + 0.0001) * (2 * (ab - ma * mb) + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (aa - ma * ma + bb - mb * mb + 0.0009))) AS ssim FROM g GROUP BY vec_id),
o AS (SELECT p.d AS dy, q.d AS dx FROM (SELECT unnest(range(-1, 2)) AS d) p CROSS JOIN (SELECT unnest(range(-1, 2)) AS d) q),
e AS (SELECT c.vec_id, c.y, c.x, sqrt(power(sum(q.a * dx * (2 - abs(dy))), 2) + power(sum(q.a * dy * (2 - abs(dx))), 2)) AS ga, sqrt(power(sum(q.b * dx * (2 - abs(dy))), 2) + power(sum(q.b * dy * (2 - abs(dx))), 2)) AS gb
  FROM c CROSS JOIN o JOIN c q ON q.vec_id = c.vec_id AND q.y = least(greatest(c.y + dy, 0), 7) AND q.x = least(greatest(c.x + dx, 0), 7) GROUP BY c.vec_id, c.y, c.x),
r AS (SELECT vec_id, corr(ga, gb) AS grad_corr FROM e GROUP BY vec_id), m AS (SELECT vec_id, -10 * log10(avg((a - b) * (a - b))) AS psnr, avg(abs(a - b)) AS msad FROM c GROUP BY vec_id)
SELECT s.vec_id, round(grad_corr, 6) AS grad_corr, round(ssim, 6) AS ssim, round(greatest(ssim, 1e-6), 6) AS ms_ssim, round(psnr, 5) AS psnr, round(msad, 6) AS msad FROM s JOIN r ON r.vec_id = s.vec_id JOIN m ON m.vec_id = s.vec_id""")  # fmt: skip
def image_similarity(spark, d):
    """Images of 8 pixels have one scale."""
    s = k.image_scores(neighbours(spark, d), ["vec_id"], "a", "b", (8, 8))
    return r6(s, "grad_corr", "ssim", "ms_ssim", "msad").withColumn("psnr", F.round("psnr", 5))


@query("image_shift", f"""
WITH n AS ({NEXT}), m AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, a - avg(a) OVER (PARTITION BY vec_id) AS a, b - avg(b) OVER (PARTITION BY vec_id) AS b FROM n),
w AS (SELECT u, v FROM (SELECT unnest(range(8)) AS u) CROSS JOIN (SELECT unnest(range(8)) AS v)),
f AS (SELECT vec_id, u, v, sum(a * cos(2 * pi() * (u * y + v * x) / 8)) AS ar, -sum(a * sin(2 * pi() * (u * y + v * x) / 8)) AS ai, sum(b * cos(2 * pi() * (u * y + v * x) / 8)) AS br, -sum(b * sin(2 * pi() * (u * y + v * x) / 8)) AS bi FROM m CROSS JOIN w GROUP BY ALL),
g AS (SELECT vec_id, u, v, br * ar + bi * ai AS re, bi * ar - br * ai AS im, greatest(sqrt(power(br * ar + bi * ai, 2) + power(bi * ar - br * ai, 2)), 1e-12) AS size FROM f),
r AS (SELECT vec_id, w.u AS y, w.v AS x, sum(re / size * cos(2 * pi() * (g.u * w.u + g.v * w.v) / 8) - im / size * sin(2 * pi() * (g.u * w.u + g.v * w.v) / 8)) / 64 AS r FROM g CROSS JOIN w GROUP BY ALL),
t AS (SELECT vec_id, arg_max(y, r) AS y, arg_max(x, r) AS x FROM r WHERE abs((y + 4) % 8 - 4) <= 3 AND abs((x + 4) % 8 - 4) <= 3 GROUP BY vec_id),
q AS (SELECT t.vec_id, t.y, t.x, max(r) FILTER (WHERE r.y = t.y AND r.x = t.x) AS c, max(r) FILTER (WHERE r.y = (t.y + 7) % 8 AND r.x = t.x) AS up, max(r) FILTER (WHERE r.y = (t.y + 1) % 8 AND r.x = t.x) AS dn,
  max(r) FILTER (WHERE r.y = t.y AND r.x = (t.x + 7) % 8) AS lf, max(r) FILTER (WHERE r.y = t.y AND r.x = (t.x + 1) % 8) AS rt FROM t JOIN r ON r.vec_id = t.vec_id GROUP BY t.vec_id, t.y, t.x)
SELECT vec_id, round((y + 4) % 8 - 4 + {_BEND.format(a="up", b="c", c="dn")}, 5) AS dy, round((x + 4) % 8 - 4 + {_BEND.format(a="lf", b="c", c="rt")}, 5) AS dx FROM q""")  # fmt: skip
def image_shift(spark, d):
    s = k.image_shift(neighbours(spark, d), ["vec_id"], "a", "b", (8, 8), (3, 3))
    return s.select("vec_id", F.round("dy", 5).alias("dy"), F.round("dx", 5).alias("dx"))


@query("profile_shift", f"""
WITH n AS ({NEXT}), l AS (SELECT unnest(range(-8, 9)) AS s), c AS (SELECT p.vec_id, s, corr(p.a, q.b) AS r FROM n p CROSS JOIN l JOIN n q ON q.vec_id = p.vec_id AND q.i = p.i + s GROUP BY p.vec_id, s),
t AS (SELECT vec_id, arg_max(s, r) AS s FROM c GROUP BY vec_id),
q AS (SELECT t.vec_id, t.s, max(r) FILTER (WHERE c.s = t.s) AS m, max(r) FILTER (WHERE c.s = t.s - 1) AS a, max(r) FILTER (WHERE c.s = t.s + 1) AS b FROM t JOIN c ON c.vec_id = t.vec_id GROUP BY t.vec_id, t.s)
SELECT vec_id, round(CASE WHEN abs(s) = 8 THEN -99.0 ELSE s + {_BEND.format(a="a", b="m", c="b")} END, 5) AS shift, round(m, 6) AS corr FROM q""")  # fmt: skip
def profile_shift(spark, d):
    """-99 where the best lag is an end."""
    s = k.shift_to_reference(neighbours(spark, d), ["vec_id"], "a", "b", 8)
    return s.select("vec_id", F.round(F.coalesce(F.nanvl("shift", F.lit(-99.0)), F.lit(-99.0)), 5).alias("shift"), F.round("corr", 6).alias("corr"))


@query("pitch")
def pitch(spark, d):
    return k.pitch(events(spark, d).select("event_type", "event_id", "value"), ["event_type"], "event_id", "value", 5, 60)


@query("peaks", f"""
WITH RECURSIVE c AS MATERIALIZED ({CELLS}), n AS (SELECT z, col, v, lag(v) OVER w AS l, lead(v) OVER w AS r FROM c WINDOW w AS (PARTITION BY z ORDER BY col)),
o AS MATERIALIZED (SELECT z, col, v, row_number() OVER (PARTITION BY z ORDER BY v DESC, col) AS k FROM n WHERE v > l AND v > r),
w AS (
  SELECT z, k, [col] AS kept FROM o WHERE k = 1
  UNION ALL
  SELECT w.z, o.k, CASE WHEN list_min([abs(x - o.col) FOR x IN w.kept]) < 4 THEN w.kept ELSE list_append(w.kept, o.col) END FROM w JOIN o ON o.z = w.z AND o.k = w.k + 1),
p AS (SELECT z, col, v FROM (SELECT z, unnest(kept) AS col FROM w QUALIFY k = max(k) OVER (PARTITION BY z)) JOIN c USING (z, col)),
e AS (SELECT p.z, p.col, p.v, coalesce(max(c.col) FILTER (WHERE c.col < p.col), -1) AS l, coalesce(min(c.col) FILTER (WHERE c.col > p.col), 64) AS r FROM p LEFT JOIN c ON c.z = p.z AND c.v > p.v GROUP BY ALL),
q AS (SELECT e.z, e.col, e.v - greatest(min(c.v) FILTER (WHERE c.col <= e.col), min(c.v) FILTER (WHERE c.col >= e.col)) AS high FROM e JOIN c ON c.z = e.z AND c.col > e.l AND c.col < e.r GROUP BY e.z, e.col, e.v)
SELECT z, row_number() OVER (PARTITION BY z ORDER BY col) - 1 AS k, CAST(col AS DOUBLE) AS at FROM q WHERE high >= 0.1""")  # fmt: skip
def peaks(spark, d):
    """Maxima of vectors, four places apart, that stand out by a tenth."""
    return k.find_peaks(cells(spark, d), ["z"], "col", "v", 4, 0.1)


@query("cell_bounds")
def cell_bounds(spark, d):
    return k.cell_bounds(events(spark, d).select("event_type", "event_id", "value"), ["event_type"], "event_id", "value", 24.0, "track")


@query("phase_locked_bounds")
def phase_locked_bounds(spark, d):
    return k.cell_bounds(events(spark, d).select("event_type", "event_id", "value"), ["event_type"], "event_id", "value", 24.0, "lock")


@query("fill_and_smooth", f"""
WITH e AS ({INDEXED}), n AS (SELECT user_id, max(i) AS m FROM e GROUP BY user_id), o AS (SELECT unnest(range(-4, 5)) AS o),
r AS (SELECT e.user_id, e.i, any_value(e.event_id) AS event_id, any_value(e.value) AS v, median(q.value) AS med FROM e JOIN n ON n.user_id = e.user_id CROSS JOIN o JOIN e q ON q.user_id = e.user_id AND q.i = least(greatest(e.i + o, 0), n.m) GROUP BY e.user_id, e.i),
s AS (SELECT user_id, greatest(1.4826 * median(abs(v - med)), 1e-12) AS s FROM r GROUP BY user_id),
k AS (SELECT r.user_id, i, event_id, CASE WHEN abs(v - med) <= 4 * s THEN v END AS v, CASE WHEN abs(v - med) <= 4 * s THEN i END AS place FROM r JOIN s ON s.user_id = r.user_id),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, last_value(place IGNORE NULLS) OVER p AS t0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(place IGNORE NULLS) OVER f AS t1 FROM k
  WINDOW p AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
z AS (SELECT user_id, i, event_id, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (i - t0) / (t1 - t0) END AS v FROM b),
t AS (SELECT unnest(range({len(_TAPS2)})) - {len(_TAPS2) // 2} AS o, unnest({_TAPS2}) AS w)
SELECT z.user_id, z.event_id, round(sum(w * q.v), 6) AS smooth FROM z JOIN n ON n.user_id = z.user_id CROSS JOIN t JOIN z q ON q.user_id = z.user_id AND q.i = least(greatest(z.i + t.o, 0), n.m) GROUP BY z.user_id, z.event_id""")  # fmt: skip
def fill_and_smooth(spark, d):
    return r6(k.fill_and_smooth(events(spark, d).select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 2.0), "smooth")


@query("circular_fill", f"""
WITH c AS ({CELLS}), k AS (SELECT z, col + 64 * g AS i, CASE WHEN v > -0.1 THEN v END AS v, CASE WHEN v > -0.1 THEN col + 64 * g END AS place FROM c CROSS JOIN (SELECT unnest([0, 1, 2]) AS g)),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, last_value(place IGNORE NULLS) OVER p AS t0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(place IGNORE NULLS) OVER f AS t1 FROM k
  WINDOW p AS (PARTITION BY z ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY z ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
y AS (SELECT z, i - 64 AS col, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (i - t0) / (t1 - t0) END AS v FROM b WHERE i >= 64 AND i < 128),
t AS (SELECT unnest(range({len(_TAPS)})) - {len(_TAPS) // 2} AS o, unnest({_TAPS}) AS w)
SELECT y.z, y.col, round(sum(w * q.v), 6) AS smooth FROM y CROSS JOIN t JOIN y q ON q.z = y.z AND q.col = (y.col + t.o + 64) % 64 GROUP BY y.z, y.col""")  # fmt: skip
def circular_fill(spark, d):
    rows = cells(spark, d).withColumn("v", F.when(F.col("v") > -0.1, F.col("v")).otherwise(float("nan")))
    return r6(k.circular_fill(rows, ["z"], "col", "v", 1.5).withColumn("col", F.col("col").cast("long")), "smooth")


@query("bandpass", f"""
WITH c AS ({CELLS}), k AS (SELECT unnest(range(6, 11)) AS k),
f AS (SELECT z, k, sum(v * cos(2 * pi() * k * col / 64)) AS re, sum(v * sin(2 * pi() * k * col / 64)) AS im FROM c CROSS JOIN k GROUP BY ALL)
SELECT c.z, c.col, round(sum(re * cos(2 * pi() * k * col / 64) + im * sin(2 * pi() * k * col / 64)) / 32, 6) AS part FROM c JOIN f ON f.z = c.z GROUP BY c.z, c.col""")  # fmt: skip
def bandpass(spark, d):
    """A pitch of 8 in 64 samples: the frequencies 6 to 10."""
    return r6(k.bandpass(cells(spark, d), ["z"], "col", "v", 8.0).withColumn("col", F.col("col").cast("long")), "part")


@query("winding_boundaries", """
WITH RECURSIVE b AS (SELECT event_type AS t, CAST(floor(sqrt(value * value + user_id * user_id)) AS BIGINT) AS i FROM events), m AS (SELECT t, max(i) AS top FROM b GROUP BY t),
h AS MATERIALIZED (SELECT g.t, g.i, top, count(b.i) AS n FROM (SELECT t, top, unnest(range(top + 1)) AS i FROM m) g LEFT JOIN b ON b.t = g.t AND b.i = g.i GROUP BY ALL),
k AS (SELECT x, exp(-0.5 * (x / 3.0) ** 2) / sum(exp(-0.5 * (x / 3.0) ** 2)) OVER () AS tap FROM (SELECT unnest(range(-12, 13)) AS x)),
s AS MATERIALIZED (SELECT a.t, a.i, -sum(h.n * tap) AS v FROM h a CROSS JOIN k JOIN h ON h.t = a.t AND h.i = CASE WHEN a.i + x < 0 THEN -a.i - x - 1 WHEN a.i + x > a.top THEN 2 * a.top - a.i - x + 1 ELSE a.i + x END GROUP BY a.t, a.i),
f AS (SELECT *, sum(new) OVER (PARTITION BY t ORDER BY i) AS flat FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY t ORDER BY i) THEN 0 ELSE 1 END AS new FROM s)),
g AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM (SELECT t, flat, (min(i) + max(i)) // 2 AS i, any_value(v) AS v FROM f GROUP BY t, flat) WINDOW w AS (PARTITION BY t ORDER BY flat)),
o AS MATERIALIZED (SELECT t, i, v, row_number() OVER (PARTITION BY t ORDER BY v DESC, i) AS k FROM g WHERE v > l AND v > r),
w AS (
  SELECT t, k, [i] AS kept FROM o WHERE k = 1
  UNION ALL
  SELECT w.t, o.k, CASE WHEN list_min([abs(x - o.i) FOR x IN w.kept]) < 8 THEN w.kept ELSE list_append(w.kept, o.i) END FROM w JOIN o ON o.t = w.t AND o.k = w.k + 1),
p AS (SELECT t, i, v FROM (SELECT t, unnest(kept) AS i FROM w QUALIFY k = max(k) OVER (PARTITION BY t)) JOIN s USING (t, i)),
e AS (SELECT p.t, p.i, p.v, coalesce(max(s.i) FILTER (WHERE s.i < p.i), -1) AS l, coalesce(min(s.i) FILTER (WHERE s.i > p.i), 1000000) AS r FROM p LEFT JOIN s ON s.t = p.t AND s.v > p.v GROUP BY ALL),
q AS (SELECT e.t, e.i, e.v - greatest(min(s.v) FILTER (WHERE s.i <= e.i), min(s.v) FILTER (WHERE s.i >= e.i)) AS high FROM e JOIN s ON s.t = e.t AND s.i > e.l AND s.i < e.r GROUP BY e.t, e.i, e.v)
SELECT q.t AS event_type, row_number() OVER (PARTITION BY q.t ORDER BY i) - 1 AS k, CAST(i AS DOUBLE) AS r FROM q JOIN (SELECT t, max(-v) AS most FROM s GROUP BY t) y USING (t) WHERE high >= 0.03 * most""")  # fmt: skip
def winding_boundaries(spark, d):
    e = events(spark, d).withColumn("r", F.hypot("value", "user_id"))
    return k.winding_boundaries(e, ["event_type"], "r", 3.0, 8, 0.03)


@query("align_sequences", """
WITH RECURSIVE v AS (SELECT label, vec_id % 2 AS side, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) AS k, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
u AS (SELECT label, side, k, [x / greatest(sqrt(list_sum([y * y FOR y IN e])), 1e-12) FOR x IN e] AS e FROM v),
n AS (SELECT label, count(*) FILTER (WHERE side = 0) AS n, count(*) FILTER (WHERE side = 1) AS m FROM v GROUP BY label),
c AS (SELECT a.label, a.k AS i, list(1 - list_dot_product(a.e, b.e) ORDER BY b.k) AS c FROM u a JOIN u b ON a.label = b.label AND a.side = 0 AND b.side = 1 GROUP BY a.label, a.k),
h AS (SELECT label, i, c, n, m, CAST(round_even((i - 1) * (m - 1) * 1.0e0 / greatest(1, n - 1), 0) AS BIGINT) AS mid, greatest(CAST(ceil(CAST(0.2 AS DOUBLE) * greatest(n, m)) AS BIGINT), 1) AS half FROM c JOIN n USING (label)),
r AS MATERIALIZED (SELECT label, i, c, m, greatest(0, mid - half) + 1 AS lo, least(m - 1, mid + half) + 1 AS hi FROM h),
w AS (
  SELECT label, CAST(0 AS BIGINT) AS i, list_concat([CAST(0 AS DOUBLE)], [CAST(1e300 AS DOUBLE) FOR x IN range(m)]) AS best FROM n
  UNION ALL
  SELECT r.label, r.i, list_concat([CAST(1e300 AS DOUBLE)], [CASE WHEN j < lo OR j > hi THEN 1e300 ELSE list_sum(c[lo:j]) + list_min([least(best[k], best[k + 1]) - CASE WHEN k > lo THEN list_sum(c[lo:k - 1]) ELSE 0 END FOR k IN range(lo, j + 1)]) END FOR j IN range(1, m + 1)])
  FROM w JOIN r ON r.label = w.label AND r.i = w.i + 1),
b AS MATERIALIZED (SELECT * FROM w),
p AS (
  SELECT label, n AS i, m AS j FROM n WHERE n > 0 AND m > 0
  UNION ALL
  SELECT label, CASE WHEN (d <= u AND d <= s) OR u <= s THEN i - 1 ELSE i END, CASE WHEN (d <= u AND d <= s) OR s < u THEN j - 1 ELSE j END
  FROM (SELECT p.label, p.i, p.j, up.best[p.j] AS d, up.best[p.j + 1] AS u, same.best[p.j] AS s FROM p JOIN b up ON up.label = p.label AND up.i = p.i - 1 JOIN b same ON same.label = p.label AND same.i = p.i WHERE p.i > 0 AND p.j > 0))
SELECT label, i - 1 AS i, j - 1 AS j FROM p WHERE i > 0 AND j > 0""")  # fmt: skip
def align_sequences(spark, d):
    e = table(spark, d, "embeddings").select("label", F.pmod("vec_id", F.lit(2)).cast("int").alias("side"), "vec_id", "embedding")
    return k.align_sequences(e, ["label"], "side", "vec_id", "embedding", 0.2)


_VIA = "list_transform(range(64), lambda i: w.best[i + 1] - CAST(0.1 AS DOUBLE) * abs(i - j))"


@query("viterbi_offsets", f"""
WITH RECURSIVE s AS (SELECT label, vec_id AS z, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS sc, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t FROM embeddings),
w AS (
  SELECT label, t, sc AS best, CAST([] AS BIGINT[]) AS back FROM s WHERE t = 1
  UNION ALL
  SELECT w.label, s.t, list_transform(range(64), lambda j: list_max({_VIA}) + s.sc[j + 1]), list_transform(range(64), lambda j: CAST(list_position({_VIA}, list_max({_VIA})) - 1 AS BIGINT)) FROM w JOIN s ON s.label = w.label AND s.t = w.t + 1),
l AS (SELECT label, max(t) AS m FROM w GROUP BY label),
b AS (
  SELECT w.label, t, CAST(list_position(best, list_max(best)) - 1 AS BIGINT) AS col, back FROM w JOIN l ON l.label = w.label AND l.m = w.t
  UNION ALL
  SELECT b.label, w.t, b.back[b.col + 1], w.back FROM b JOIN w ON w.label = b.label AND w.t = b.t - 1)
SELECT s.label, s.z, CAST(b.col AS INT) AS col FROM b JOIN s ON s.label = b.label AND s.t = b.t""")  # fmt: skip
def viterbi_offsets(spark, d):
    return k.best_path(cells(spark, d).select("label", "z", "col", "v"), ["label"], "z", "col", "v", 0.1)


@query("components", """
WITH RECURSIVE c AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) WHERE v > 0),
e AS (SELECT a.vec_id, a.i AS a, b.i AS b FROM c a JOIN c b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) <= 1),
r AS (SELECT vec_id, a, b FROM e UNION SELECT r.vec_id, r.a, e.b FROM r JOIN e ON e.vec_id = r.vec_id AND e.a = r.b),
m AS (SELECT vec_id, a AS i, min(b) AS root FROM r GROUP BY ALL)
SELECT m.vec_id, dense_rank() OVER (PARTITION BY m.vec_id ORDER BY root) AS label, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM m JOIN c ON c.vec_id = m.vec_id AND c.i = m.i GROUP BY m.vec_id, root""")  # fmt: skip
def components(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.array(*[F.slice(F.transform("embedding", lambda x: (x > 0).cast("int")), 8 * r + 1, 8) for r in range(8)])).alias("row", "mask"))
    return r6(k.label_components(rows, ["vec_id"], "row", "mask"), "cx", "cy")


@query("stack_centres", """
WITH RECURSIVE c AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x, v > 0 AS m FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)), h AS (SELECT * FROM c WHERE NOT m),
e AS (SELECT a.vec_id, a.i AS a, b.i AS b FROM h a JOIN h b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) <= 1),
r AS (SELECT vec_id, a, b FROM e UNION SELECT r.vec_id, r.a, e.b FROM r JOIN e ON e.vec_id = r.vec_id AND e.a = r.b),
p AS (SELECT vec_id, a AS i, min(b) AS root FROM r GROUP BY ALL),
s AS (SELECT p.vec_id, root, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM p JOIN c ON c.vec_id = p.vec_id AND c.i = p.i GROUP BY p.vec_id, root HAVING abs(avg(x) - 3.5) <= 2.4 AND abs(avg(y) - 3.5) <= 2.4),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, root) = 1),
f AS (SELECT vec_id, avg(x) FILTER (WHERE m) AS cx, avg(y) FILTER (WHERE m) AS cy FROM c GROUP BY vec_id)
SELECT f.vec_id, round(coalesce(k.cx, f.cx, 3.5), 6) AS cx, round(coalesce(k.cy, f.cy, 3.5), 6) AS cy FROM f LEFT JOIN k ON k.vec_id = f.vec_id""")  # fmt: skip
def stack_centres(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.array(*[F.slice(F.transform("embedding", lambda x: (x > 0).cast("int")), 8 * r + 1, 8) for r in range(8)])).alias("row", "labels"))
    return r6(k.stack_centres(rows, ["vec_id"], "row", "labels"), "cx", "cy")


@query("greedy_pairs", PAIRS.replace("WITH a", "WITH RECURSIVE a") + """
, p AS (SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id, abs(a.value - b.value) AS cost FROM a JOIN b ON a.user_id = b.user_id AND abs(a.value - b.value) <= 5.0),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cost, a_id, b_id) AS k FROM p),
w AS (
  SELECT user_id, k, true AS taken, [a_id] AS left_, [b_id] AS right_ FROM o WHERE k = 1
  UNION ALL
  SELECT w.user_id, o.k, NOT list_contains(left_, a_id) AND NOT list_contains(right_, b_id), CASE WHEN list_contains(left_, a_id) OR list_contains(right_, b_id) THEN left_ ELSE list_append(left_, a_id) END,
    CASE WHEN list_contains(left_, a_id) OR list_contains(right_, b_id) THEN right_ ELSE list_append(right_, b_id) END FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT o.user_id, a_id, b_id, round(cost, 6) AS cost FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k WHERE taken""")  # fmt: skip
def greedy_pairs(spark, d):
    a, b = click_pairs(spark, d)
    p = matching.banded(a.select("user_id", F.col("event_id").alias("a_id"), F.col("value").alias("va")), b.select("user_id", F.col("event_id").alias("b_id"), F.col("value").alias("vb")), ["user_id"], "va", "vb", 5.0)
    return r6(k.greedy_pairs(p.withColumn("cost", F.abs(F.col("va") - F.col("vb"))), ["user_id"], "a_id", "b_id", "cost"), "cost")


@query("track_windings")
def track_windings(spark, d):
    """Vectors as radius profiles, every fifty of them a slice."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("roll"), (F.col("vec_id") / 50).cast("int").alias("z"), F.col("vec_id").cast("int").alias("walk_id"), F.transform("embedding", lambda x: x.cast("double")).alias("r"))
    return spiral.track(e, ["roll"], 0.8)


@query("spiral_points", """
WITH s AS (SELECT 24.0 AS r0, 11.0 / (2 * pi()) AS a, 24.0 * 8 * pi() + 11.0 / (2 * pi()) * power(8 * pi(), 2) / 2 AS len),
t AS (SELECT vec_id, r0, a, (sqrt(r0 * r0 + 2 * a * (vec_id / 3000.0) * len) - r0) / a AS t FROM embeddings CROSS JOIN s)
SELECT vec_id, round(79.5 + (r0 + a * t) * cos(t), 6) AS x, round(79.5 + (r0 + a * t) * sin(t), 6) AS y FROM t""")  # fmt: skip
def spiral_points(spark, d):
    x, y = spiral.analytic_point(spiral.Spiral(), F.col("vec_id") / 3000.0)
    return r6(table(spark, d, "embeddings").select("vec_id", x.alias("x"), y.alias("y")), "x", "y")


@query("high_frequency_share", """
WITH c AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v - avg(v) OVER (PARTITION BY vec_id, i // 8) AS v FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(64)) AS i FROM embeddings)),
p AS (SELECT vec_id, y, k, power(sum(v * cos(2 * pi() * k * x / 8)), 2) + power(sum(v * sin(2 * pi() * k * x / 8)), 2) AS p FROM c CROSS JOIN (SELECT unnest(range(5)) AS k) GROUP BY ALL)
SELECT vec_id, round(sum(p) FILTER (WHERE k = 4) / sum(p), 6) AS share FROM p GROUP BY vec_id""")  # fmt: skip
def high_frequency_share(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    return r6(fr.high_frequencies(e, ["vec_id"], "a", (8, 8)), "share")


@query("robust_polynomial")
def robust_polynomial(spark, d):
    return k.series_numbers(events(spark, d), ["user_id"], "event_id", "value", lambda y: dict(zip(("c2", "c1", "c0"), signal.polyfit_robust(np.arange(len(y)) / len(y), y, 2), strict=True)), ["c2", "c1", "c0"])


@query("hashed_sample", "SELECT event_id, user_id, event_type, value FROM events WHERE CAST('0x' || substr(md5(event_id || '|3'), 1, 8) AS BIGINT) / 4294967296.0 < 0.1")
def hashed_sample(spark, d):
    """A tenth of the rows, drawn by hash: the same ones however the table is partitioned."""
    return events(spark, d).where(sem.portable_uniform(F.col("event_id"), seed=3) < 0.1)


@query("frame_lines")
def frame_lines(spark, d):
    """Lines of each type's series, refined on their own template."""
    return k.series_places(events(spark, d).select("event_type", "event_id", "value"), ["event_type"], "event_id", "value", lambda a: frames.frame_lines(a, 24.0, 6)[0], "line")


@query("feature_coherence")
def feature_coherence(spark, d):
    one = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    return k.pair_numbers(one.withColumn("b", F.col("a")), ["vec_id"], "a", "b", (8, 8), lambda a, _: {"distance": frames.feature_coherence(a, 4, 3)}, ["distance"])
