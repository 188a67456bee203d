"""Queries of samples, pairs, seeds and band measures, with the SQL that states them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import bands, ordered, sampling
from lamina.plans.queries_image import PIXELS
from lamina.plans.queries_native import CELLS, FIRST, INDEXED, cells, click_pairs, events, indexed, r6
from lamina.plans.registry import query, table

_U = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) / 4294967296.0"
_RUNS = f"""WITH c AS ({CELLS}), s AS (SELECT *, col - row_number() OVER (PARTITION BY z ORDER BY col) AS g FROM c WHERE v > 0),
r AS (SELECT label, z, min(col) AS lo, max(col) AS hi FROM s GROUP BY label, z, g)"""


def _first(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("r"))


@query("z_pairs", f"""
WITH e AS ({INDEXED}) SELECT a.user_id, a.i, a.value, b.value AS next FROM e a JOIN e b ON b.user_id = a.user_id AND b.i = a.i + 1 WHERE {_U.format("a.user_id || '|' || a.i || '|7'")} < 0.3""")  # fmt: skip
def z_pairs(spark, d):
    return sampling.z_pairs(indexed(spark, d), ["user_id"], "i", "value", 0.3, seed=7)


_DRAW = "CAST(floor({u} * (SELECT count(*) FROM embeddings)) AS BIGINT)"


@query("inner_first_pairs", f"""
WITH k AS (SELECT unnest(range(400)) AS k), p AS (SELECT k, {_DRAW.format(u=_U.format("k || '|0|2'"))} AS i, {_DRAW.format(u=_U.format("k || '|1|2'"))} AS j FROM k)
SELECT k, CASE WHEN (a.embedding[1], i) <= (b.embedding[1], j) THEN i ELSE j END AS "inner", CASE WHEN (a.embedding[1], i) <= (b.embedding[1], j) THEN j ELSE i END AS "outer" FROM p JOIN embeddings a ON a.vec_id = i JOIN embeddings b ON b.vec_id = j""")  # fmt: skip
def inner_first_pairs(spark, d):
    return sampling.inner_first_pairs(_first(spark, d), "vec_id", "r", 400, seed=2)


@query("angular_pairs", f"""
WITH k AS (SELECT k, c FROM (SELECT unnest(range(300)) AS k) CROSS JOIN (SELECT unnest(range(1, 11)) AS c)),
p AS (SELECT k, {_DRAW.format(u=_U.format("k || '|0|4'"))} AS one, {_DRAW.format(u=_U.format("k || '|' || c || '|4'"))} AS other FROM k),
g AS (SELECT k, one, other, abs(CAST(a.embedding[1] AS DOUBLE) - CAST(b.embedding[1] AS DOUBLE)) AS g FROM p JOIN embeddings a ON a.vec_id = one JOIN embeddings b ON b.vec_id = other WHERE one <> other)
SELECT k, one, arg_min(other, (g, other)) AS other FROM g WHERE g < 0.02 GROUP BY k, one""")  # fmt: skip
def angular_pairs(spark, d):
    return sampling.angular_pairs(_first(spark, d), "vec_id", "r", 300, 0.02, seed=4)


@query("stratified_sample", f"""
SELECT event_id, CASE WHEN value < 5 THEN 0 WHEN value > 60 THEN 1 ELSE 2 END AS stratum FROM events WHERE {_U.format("event_id || '|1'")} < CASE WHEN value < 5 THEN 0.5 WHEN value > 60 THEN 0.25 ELSE 0.1 END""")  # fmt: skip
def stratified_sample(spark, d):
    v = F.col("value")
    return sampling.stratified(events(spark, d), ["event_id"], [(v < 5, 0.5), (v > 60, 0.25), (F.lit(True), 0.1)], seed=1).select("event_id", "stratum")


@query("uv_grid", "SELECT i // 40 AS row, i % 40 AS col, round(i % 40 / 39.0, 6) AS u FROM (SELECT unnest(range(40 * (SELECT count(*) FROM embeddings))) AS i)")
def uv_grid(spark, d):
    """A grid with a row for each vector."""
    return r6(sampling.uv_grid(spark, 40, table(spark, d, "embeddings").count()), "u")


@query("seed_ray_by_count", _RUNS + """, n AS (SELECT label, z, count(*) AS n FROM r GROUP BY ALL), f AS (SELECT * FROM n WHERE n = (SELECT floor(quantile_cont(n, 0.995)) FROM n) ORDER BY label, z LIMIT 1)
SELECT r.label, r.z, lo, hi, n FROM r JOIN f ON f.label = r.label AND f.z = r.z""")  # fmt: skip
def seed_ray_by_count(spark, d):
    found = ordered.runs(cells(spark, d), ["label", "z"], "col", F.col("v") > 0).select("label", "z", "lo", "hi")
    return bands.seed_ray_by_count(found, "label", "z")


@query("winding_seeds", f"""
WITH c AS ({CELLS}), p AS (SELECT label, 40 * abs(v) AS r FROM c WHERE least(abs(2 * pi() * col / 64 - 0.5), 2 * pi() - abs(2 * pi() * col / 64 - 0.5)) <= 0.25),
g AS (SELECT *, CASE WHEN r - lag(r) OVER (PARTITION BY label ORDER BY r) >= 0.3 THEN 1 ELSE 0 END AS new FROM p), w AS (SELECT *, sum(new) OVER (PARTITION BY label ORDER BY r ROWS UNBOUNDED PRECEDING) AS winding FROM g)
SELECT label, CAST(winding AS BIGINT) AS winding, round(median(r), 6) AS r, count(*) AS n FROM w GROUP BY label, winding""")  # fmt: skip
def winding_seeds(spark, d):
    p = cells(spark, d).select("label", (F.col("col") * 2 * F.pi() / 64).alias("phi"), (F.abs("v") * 40).alias("r"))
    return r6(bands.winding_seeds(p, ["label"], "phi", "r", 0.5, 0.25, 0.3), "r")


@query("ring_check", f"""
WITH p AS (SELECT user_id, value, row_number() OVER (ORDER BY event_id) AS i FROM events WHERE event_type <> {FIRST}), b AS (SELECT user_id, value, row_number() OVER (ORDER BY event_id) AS i FROM events WHERE event_type = {FIRST}),
bb AS (SELECT b.user_id, b.i, count(p.i) AS n FROM b LEFT JOIN p ON p.user_id = b.user_id AND abs(p.value - b.value) <= 0.4 GROUP BY ALL), pp AS (SELECT p.user_id, p.i, count(b.i) AS n FROM p LEFT JOIN b ON p.user_id = b.user_id AND abs(p.value - b.value) <= 0.4 GROUP BY ALL),
x AS (SELECT user_id, count(*) FILTER (WHERE n = 0) AS skipped, count(*) FILTER (WHERE n > 1) AS doubled FROM bb GROUP BY user_id), y AS (SELECT user_id, count(*) FILTER (WHERE n = 0) AS lone FROM pp GROUP BY user_id)
SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(skipped, 0) AS skipped, coalesce(doubled, 0) AS doubled, coalesce(lone, 0) AS lone FROM x FULL JOIN y ON x.user_id = y.user_id""")  # fmt: skip
def ring_check(spark, d):
    true, guess = click_pairs(spark, d)
    return bands.ring_check(guess, true, ["user_id"], "value", 0.4)


@query("gap_profile", f"""
WITH c AS ({CELLS}), n AS (SELECT z, v > 0 AS hot, lead(v > 0) OVER (PARTITION BY z ORDER BY col) AS after FROM c) SELECT z, count(*) FILTER (WHERE hot AND NOT after) AS ends FROM n GROUP BY z""")  # fmt: skip
def gap_profile(spark, d):
    return bands.gap_profile(cells(spark, d), ["z"], "col", F.col("v") > 0)


@query("flatness", f"""
WITH c AS ({CELLS}), p AS (SELECT z, v - avg(v) OVER (PARTITION BY z ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS h, abs(v - lag(v) OVER (PARTITION BY z ORDER BY col)) AS s FROM c)
SELECT z, round(stddev_pop(h), 6) AS rough, round(quantile_cont(s, 0.99), 6) AS steepest FROM p GROUP BY z""")  # fmt: skip
def flatness(spark, d):
    return r6(bands.flatness(cells(spark, d), ["z"], "col", "v"), "rough", "steepest")


@query("band_pair", f"""
WITH c AS (SELECT * FROM ({CELLS}) WHERE v > 0.05), p AS (SELECT a.z, a.col AS lo, b.col AS hi, a.v + b.v - abs(b.col - a.col - 20) / 20.0 AS score FROM c a JOIN c b ON b.z = a.z AND b.col > a.col AND abs(b.col - a.col - 20) <= 6)
SELECT z, lo, hi, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY z ORDER BY score DESC, lo, hi) = 1""")  # fmt: skip
def band_pair(spark, d):
    return r6(bands.band_pair(cells(spark, d).where("v > 0.05"), ["z"], "col", "v", 20.0, 6.0), "score")


@query("widest_bands", f"""
WITH c AS (SELECT *, v > max(v) OVER (PARTITION BY z) / 8 * 4 AS hot FROM (SELECT z, col, abs(v) AS v FROM ({CELLS}))), s AS (SELECT *, col - row_number() OVER (PARTITION BY z ORDER BY col) AS g FROM c WHERE hot),
r AS (SELECT z, min(col) AS lo, max(col) AS hi, count(*) AS n FROM s GROUP BY z, g HAVING count(*) >= 2), k AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY n DESC, lo) AS k FROM r)
SELECT z, lo, hi, n, count(*) OVER (PARTITION BY z) >= 2 AS complete FROM k WHERE k <= 2""")  # fmt: skip
def widest_bands(spark, d):
    return bands.widest_bands(cells(spark, d).withColumn("v", F.abs("v")), ["z"], "col", "v", 2)


def _pixels(spark, d):
    return cells(spark, d).select("z", "label", F.floor(F.col("col") / 8).cast("int").alias("y"), (F.col("col") % 8).cast("int").alias("x"), "v")


@query("median_sharpness", f"""
WITH m AS (SELECT label, col // 8 AS y, col % 8 AS x, median(v) AS m FROM ({CELLS}) GROUP BY ALL), s AS (SELECT label, lead(m) OVER (PARTITION BY label, y ORDER BY x) - m AS dx, lead(m) OVER (PARTITION BY label, x ORDER BY y) - m AS dy FROM m)
SELECT label, round(avg(dx * dx) + avg(dy * dy), 8) AS sharpness FROM s GROUP BY label""")  # fmt: skip
def median_sharpness(spark, d):
    return bands.median_sharpness(_pixels(spark, d), ["label"], "y", "x", "v").withColumn("sharpness", F.round("sharpness", 8))


@query("sheared", f"""
WITH c AS ({PIXELS}), p AS (SELECT vec_id, y, x, least(greatest(x + 0.3 * y, 0.0), 7.0) AS q FROM c)
SELECT p.vec_id AS z, CAST(p.y AS INT) AS y, CAST(p.x AS INT) AS x, round(a.v + (b.v - a.v) * (q - least(floor(q), 6)), 6) + 0.0 AS v FROM p JOIN c a ON a.vec_id = p.vec_id AND a.y = p.y AND a.x = least(floor(q), 6) JOIN c b ON b.vec_id = p.vec_id AND b.y = p.y AND b.x = least(floor(q), 6) + 1""")  # fmt: skip
def sheared(spark, d):
    return r6(bands.shear(_pixels(spark, d), ["z"], "y", "x", "v", 0.3, 8), "v").withColumn("v", F.col("v") + 0.0)
