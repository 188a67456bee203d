"""Queries of operators on data larger than a task, on the tables: embeddings as strips and stacks
(a label is a strip or slice, its vectors are rows in order of their ids), events and orders as
samples. Their SQL looks at all pairs or all samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lamina.functions.semantics import ordered
from lamina.operators import blocks as op
from lamina.operators import matching, regions, rounds, search
from lamina.plans.queries_native import r6
from lamina.plans.registry import query, table

STRIPS = """SELECT label, "row", unnest(range(64)) AS col, unnest(e) AS v FROM (
  SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS "row", [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)"""


def strips(spark, d, width):
    """embeddings as blocks: label, row, block, values."""
    e = table(spark, d, "embeddings").withColumn("row", F.row_number().over(ordered(["label"], "vec_id")) - 1)
    return op.to_blocks(e, ["label"], "row", "embedding", width)


def long_form(df, width, name, values="values"):
    """A row for each sample of blocks."""
    out = df.select(*[c for c in df.columns if c not in ("block", values)], "block", F.posexplode(values).alias("_i", name))
    return out.withColumn("col", (F.col("block") * width + F.col("_i")).cast("long")).drop("block", "_i")


@query("block_filter", f"""
WITH c AS ({STRIPS})
SELECT a.label, a."row", a.col, round(avg(b.v), 6) AS mean, round(max(b.v), 6) AS top FROM c a JOIN c b ON a.label = b.label AND abs(a."row" - b."row") <= 2 AND abs(a.col - b.col) <= 2
GROUP BY ALL""")  # fmt: skip
def block_filter(spark, d):
    """Means and maxima of 5 x 5 pixels, fewer at the border, from blocks of 7 rows and 16 columns."""

    def windows(a):
        return np.lib.stride_tricks.sliding_window_view(np.pad(a, 2, constant_values=np.nan), (5, 5))

    b = strips(spark, d, 16)
    both = [long_form(op.map_blocks(b, ["label"], "row", 7, 16, 2, f), 16, n) for f, n in ((lambda a: np.nanmean(windows(a), axis=(2, 3)), "mean"), (lambda a: np.nanmax(windows(a), axis=(2, 3)), "top"))]
    return r6(both[0].join(both[1], ["label", "row", "col"]), "mean", "top")


def bilinear_sql(points: str) -> str:
    """The strips' values at points (label, y, x and more), by four lookups; NULL where one that counts
    is missing."""
    at = lambda dy, dx: f'(SELECT v FROM c WHERE c.label = p.label AND c."row" = floor(p.y) + {dy} AND c.col = floor(p.x) + {dx})'
    line = lambda dy: f"CASE WHEN p.x = floor(p.x) THEN {at(dy, 0)} ELSE {at(dy, 0)} + ({at(dy, 1)} - {at(dy, 0)}) * (p.x - floor(p.x)) END"
    return f"SELECT p.*, CASE WHEN p.y < 0 OR p.x < 0 THEN NULL WHEN p.y = floor(p.y) THEN {line(0)} ELSE {line(0)} + ({line(1)} - {line(0)}) * (p.y - floor(p.y)) END AS v FROM ({points}) p"


@query("block_samples", f"""
WITH c AS MATERIALIZED ({STRIPS}), s AS ({bilinear_sql("SELECT event_id, event_id % 10 AS label, value / 9.0 AS y, (value * 7.3) % 66.0 - 1 AS x FROM events")})
SELECT event_id, label, round(v, 6) + 0e0 AS v FROM s""")  # fmt: skip
def block_samples(spark, d):
    """Strips read between pixels at places that events give; some lie outside."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 10).cast("int").alias("label"), "value")
    out = op.sample(e, strips(spark, d, 16), ["label"], "row", 7, 16, F.col("value") / 9.0, F.pmod(F.col("value") * 7.3, F.lit(66.0)) - 1)
    return out.select("event_id", F.col("label").cast("long").alias("label"), (F.round("v", 6) + 0.0).alias("v"))


_RAIL = """SELECT label, cell, col, line, y0 + (y1 - y0) * t AS y, x0 + (x1 - x0) * t AS x FROM (
  SELECT label, cell, col, line, (line + 6.0e0 - 4) / 26 AS t, 4 + label % 3 + u / 32 AS y0, 30.0e0 + label % 2 - u / 64 AS y1, u + 0.25e0 * label AS x0, u - 0.5e0 + u / 50 AS x1 FROM (
    SELECT label, cell, col, line, cell * 12.0e0 + 2 + col AS w, least(cell * 12.0e0 + 2 + col, 60) AS u FROM (SELECT DISTINCT label FROM embeddings) CROSS JOIN (SELECT unnest(range(5)) AS cell) CROSS JOIN (SELECT unnest(range(12)) AS col) CROSS JOIN (SELECT unnest(range(20)) AS line)))"""


@query("rectified_frames", f"""
WITH c AS MATERIALIZED ({STRIPS}), s AS ({bilinear_sql(_RAIL)})
SELECT label, cell, line AS "row", col, round(v, 6) + 0e0 AS v FROM s""")  # fmt: skip
def rectified_frames(spark, d):
    """Frames of twelve samples between two rails that lean and stretch, on each label's strip."""
    knots = table(spark, d, "embeddings").select("label").distinct().withColumn("u", F.explode(F.array(*map(F.lit, (0.0, 15.0, 30.0, 45.0, 60.0)))))
    low = knots.select("label", F.lit(0).alias("side"), "u", (4 + F.col("label") % 3 + F.col("u") / 32).alias("y"), (F.col("u") + 0.25 * F.col("label")).alias("x"))
    high = knots.select("label", F.lit(1), "u", 30.0 + F.col("label") % 2 - F.col("u") / 64, F.col("u") - 0.5 + F.col("u") / 50)
    out = op.rectify(strips(spark, d, 16), low.union(high), ["label"], "row", 7, 16, (4.0, 30.0), 12.0, 2.0, (6.0, 20))
    out = out.select("label", "cell", F.col("row").cast("long").alias("row"), F.posexplode("values").alias("col", "v"))
    return out.withColumns({"col": F.col("col").cast("long"), "v": F.round("v", 6) + 0.0})


@query("nearest_spots", """
WITH p AS (SELECT p_partkey, p_size * 40.0 AS x, p_retailprice AS y FROM part),
c AS (SELECT c_nationkey * 80.0 AS x, c_acctbal AS y, min(c_custkey) AS c_custkey FROM customer GROUP BY ALL),
d AS (SELECT p_partkey, c_custkey, (p.x - c.x) ** 2 + (p.y - c.y) ** 2 AS d FROM p CROSS JOIN c)
SELECT p_partkey, arg_min(c_custkey, {'d': d, 'c': c_custkey}) AS c_custkey, round(sqrt(min(d)), 6) AS distance FROM d GROUP BY p_partkey""")  # fmt: skip
def nearest_spots(spark, d):
    """For each part the nearest customer in a plane."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40.0).alias("x"), F.col("p_retailprice").alias("y"))
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 80.0).alias("x"), F.col("c_acctbal").alias("y"))
    return r6(matching.nearest_in_plane(p, c, [], "x", "y", ["c_custkey"]).select("p_partkey", "c_custkey", "distance"), "distance")


@query("region_labels", f"""
WITH RECURSIVE c AS ({STRIPS}), n AS MATERIALIZED (SELECT label AS z, "row", col, label * 4398046511104 + "row" * 2097152 + col AS id FROM c WHERE v > 0.14),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON (b.z = a.z AND b."row" = a."row" AND abs(a.col - b.col) = 1) OR (b.z = a.z AND abs(a."row" - b."row") = 1 AND a.col = b.col) OR (abs(a.z - b.z) = 1 AND a."row" = b."row" AND a.col = b.col)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.z, n."row", n.col, least(n.id, coalesce(min(r.b), n.id)) AS region FROM n LEFT JOIN r ON r.a = n.id GROUP BY n.z, n."row", n.col, n.id""")  # fmt: skip
def region_labels(spark, d):
    """Regions of a stack whose slices are the labels' strips, from blocks of 2 x 7 x 16 voxels."""
    b = op.map_blocks(strips(spark, d, 16), ["label"], "row", 64, 16, 0, lambda a: np.where(a > 0.14, 1.0, 0.0))
    out = regions.label_regions(b, [], "label", "row", 2, 7, 16)
    return long_form(out, 16, "region", "labels").where("region IS NOT NULL").withColumn("z", F.col("z").cast("int"))


@query("feature_distances", f"""
WITH c AS MATERIALIZED ({STRIPS}), f AS MATERIALIZED (SELECT * FROM c WHERE v > 0.2)
SELECT c.label, c."row", c.col, min((c."row" - f."row") ** 2 + (c.col - f.col) ** 2)::BIGINT AS squared FROM c JOIN f ON f.label = c.label GROUP BY ALL""")  # fmt: skip
def feature_distances(spark, d):
    """Squared distances to the nearest large value of each label's strip."""
    b = strips(spark, d, 16).withColumn("values", F.transform("values", lambda v: (v > 0.2).cast("double")))
    return long_form(regions.squared_distances(b, ["label"], "row", 16), 16, "squared").where("squared IS NOT NULL")


@query("narrowed_quantiles", """
SELECT round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.9999), 6) AS p9999 FROM lineitem""")  # fmt: skip
def narrowed_quantiles(spark, d):
    p = rounds.exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.05, 0.5, 0.95, 0.9999], bins=64)
    return table(spark, d, "lineitem").groupBy().agg(*[F.round(F.lit(v), 6).alias(n) for v, n in zip(p, ("p5", "p50", "p95", "p9999"), strict=True)])


_TURN = "(value * 1.013 + (event_id % 7) * 0.2) % 40.0 / 40.0"


def _spiral_sql(n: int) -> str:
    """``n`` rounds of assigning and refitting, as one query for each."""
    parts = [f"p AS (SELECT event_type, value AS r, {_TURN} AS t FROM events)", "c0 AS (SELECT DISTINCT event_type, 1.0e0 AS a, 39.0e0 AS b FROM p)"]
    for k in range(1, n + 1):
        parts.append(f"c{k} AS (SELECT event_type, regr_intercept(r, n) AS a, regr_slope(r, n) AS b, count(*) AS points FROM (SELECT p.event_type, r, t + least(greatest(round_even((r - a) / b - t, 0), 0), 12) AS n FROM p JOIN c{k - 1} USING (event_type)) GROUP BY event_type)")
    return f"WITH {', '.join(parts)} SELECT event_type, round(a, 5) AS a, round(b, 5) AS b, points FROM c{n}"


@query("refitted_spirals", _spiral_sql(3))
def refitted_spirals(spark, d):
    """Spirals through each event type's points, three rounds."""
    e = table(spark, d, "events").select("event_type", F.col("value").alias("r"), (F.pmod(F.col("value") * 1.013 + (F.col("event_id") % 7) * 0.2, F.lit(40.0)) / 40.0 * (2 * np.pi)).alias("phi"))
    out = rounds.fit_spirals(e, ["event_type"], "phi", "r", 13, (1.0, 39.0), rounds=3)
    return out.select("event_type", F.round(F.get("coefficients", F.lit(0)), 5).alias("a"), F.round(F.get("coefficients", F.lit(1)), 5).alias("b"), F.col("n").alias("points"))


def _lock_sql(n: int) -> str:
    parts = ["c AS MATERIALIZED (SELECT label, vec_id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)", "s0 AS (SELECT DISTINCT label, vec_id, 0 AS s FROM c)"]
    for k in range(1, n + 1):
        parts += [
            f"m{k} AS MATERIALIZED (SELECT label, pos - s AS pos, median(v) AS m FROM c JOIN s{k - 1} USING (label, vec_id) GROUP BY ALL)",
            f"e{k} AS (SELECT label, vec_id, g.s, round(avg((v - m) ** 2), 12) AS e, count(*) AS n FROM c CROSS JOIN (SELECT unnest(range(-3, 4)) AS s) g JOIN m{k} USING (label) WHERE m{k}.pos = c.pos - g.s GROUP BY ALL)",
            f"s{k} AS MATERIALIZED (SELECT label, vec_id, s FROM e{k} WHERE 2 * n >= 64 QUALIFY row_number() OVER (PARTITION BY label, vec_id ORDER BY e, abs(s), s) = 1)",
        ]
    return f"WITH {', '.join(parts)} SELECT label, vec_id, s AS shift FROM s{n}"


@query("locked_profiles", _lock_sql(2))
def locked_profiles(spark, d):
    """Vectors as profiles, moved by up to three places against their label's median, twice."""
    e = table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("at", "v"))
    return rounds.lock_profiles(e, ["label"], "vec_id", "at", "v", 3, rounds=2)


@query("local_lines", """
WITH e AS MATERIALIZED (SELECT user_id, value AS u, avg(event_id % 101) AS y FROM events GROUP BY ALL),
p AS (SELECT a.user_id, a.u, exp(-0.5 * ((b.u - a.u) / 6.0) ** 2) AS g, b.u - a.u AS d, b.y FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.u - b.u) <= 24),
s AS (SELECT user_id, u, sum(g) AS s0, sum(g * d) AS s1, sum(g * d * d) AS s2, sum(g * y) AS t0, sum(g * d * y) AS t1 FROM p GROUP BY ALL)
SELECT user_id, u, round(CASE WHEN s0 * s2 - s1 * s1 > 1e-9 * s0 * s0 * 36 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 5) + 0e0 AS smooth FROM s""")  # fmt: skip
def local_lines(spark, d):
    """Lines through each user's samples near each one."""
    e = table(spark, d, "events").groupBy("user_id", F.col("value").alias("u")).agg(F.avg(F.col("event_id") % 101).alias("y"))
    return rounds.local_lines(e, ["user_id"], "u", "y", 6.0).select("user_id", "u", (F.round("smooth", 5) + 0.0).alias("smooth"))


@query("held_places", """
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS v, event_id FROM events),
m AS (SELECT user_id, i, i * 50.0e0 + event_id % 11 AS x0, (v % 20) - 10 AS along, (v % 6) - 3 AS across, (v / 3) % 1 AS score, CASE WHEN event_id % 5 > 0 THEN (v % 4) - 2 END AS da, CASE WHEN event_id % 5 > 0 THEN (v % 2) - 1 END AS dz FROM e),
b AS (SELECT user_id, (arg_max(x0, i) - arg_min(x0, i)) / nullif(max(i) - min(i), 0) AS mean FROM m GROUP BY user_id),
p AS (SELECT m.*, score > 0.6 AND abs(along) <= 25 AS locked, sum(coalesce(mean + coalesce(da, 0), 0)) OVER w AS px, sum(coalesce(dz, 0)) OVER w AS pz FROM m JOIN b USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY i)),
a AS (SELECT user_id, i AS k, x0 + along AS x, across AS z, px, pz FROM p WHERE locked),
l AS (SELECT p.user_id, p.i, arg_max({'k': a.k, 'x': a.x, 'z': a.z, 'px': a.px, 'pz': a.pz}, a.k) AS l FROM p JOIN a ON a.user_id = p.user_id AND a.k <= p.i GROUP BY ALL),
r AS (SELECT p.user_id, p.i, arg_min({'k': a.k, 'x': a.x, 'z': a.z, 'px': a.px, 'pz': a.pz}, a.k) AS r FROM p JOIN a ON a.user_id = p.user_id AND a.k >= p.i GROUP BY ALL),
j AS (SELECT p.*, l.l, r.r, CASE WHEN r.r.k > l.l.k THEN (p.i - l.l.k) * 1.0e0 / (r.r.k - l.l.k) ELSE 0 END AS share FROM p LEFT JOIN l USING (user_id, i) LEFT JOIN r USING (user_id, i))
SELECT user_id, i, locked,
  round(coalesce(l.x + px - l.px + share * (r.x - l.x - r.px + l.px), l.x + px - l.px, r.x + px - r.px, x0), 5) + 0e0 AS x,
  round(coalesce(l.z + pz - l.pz + share * (r.z - l.z - r.pz + l.pz), l.z + pz - l.pz, r.z + pz - r.pz, 0), 5) + 0e0 AS z FROM j""")  # fmt: skip
def held_places(spark, d):
    """Each user's events as frames on a strip, some locked, the gaps between them closed."""
    v, e = F.col("value"), F.col("event_id")
    rows = table(spark, d, "events").withColumn("i", F.row_number().over(ordered(["user_id"], "event_id")) - 1)
    m = rows.select("user_id", "i", (F.col("i") * 50.0 + e % 11).alias("x0"), (v % 20 - 10).alias("along"), (v % 6 - 3).alias("across"), ((v / 3) % 1).alias("score"))
    s = rows.select("user_id", "i", F.when(e % 5 > 0, v % 4 - 2).alias("along"), F.when(e % 5 > 0, v % 2 - 1).alias("across"))
    out = rounds.held_places(m, s, ["user_id"], "i", 0.6, 50.0)
    return out.select("user_id", F.col("i").cast("long").alias("i"), "locked", (F.round("x", 5) + 0.0).alias("x"), (F.round("z", 5) + 0.0).alias("z"))


def _levels_sql() -> str:
    """Two levels of a grid of slopes and offsets between neighbouring vectors."""
    near = "SELECT a.label, a.v AS x, b.v AS y FROM c a JOIN c b ON b.vec_id = a.vec_id + 1 AND b.i = a.i"
    parts = ["c AS (SELECT label, vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)", f"p AS MATERIALIZED ({near})", "m AS (SELECT label, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(x * x) AS xx, avg(x * y) AS xy, avg(y * y) AS yy FROM p GROUP BY label)"]
    grids = {1: "SELECT label, -1 + i * 0.25e0 AS s, -0.5e0 + j * 0.125e0 AS o FROM m CROSS JOIN (SELECT unnest(range(9)) AS i) CROSS JOIN (SELECT unnest(range(9)) AS j)"}
    grids[2] = "SELECT label, -1 + i * 0.0625e0 AS s, -0.5e0 + j * 0.03125e0 AS o FROM b1 CROSS JOIN (SELECT unnest(range(33)) AS i) CROSS JOIN (SELECT unnest(range(33)) AS j) WHERE abs(i - (s + 1) / 0.0625) < 4.5 AND abs(j - (o + 0.5) / 0.03125) < 4.5"
    for k in (1, 2):
        parts.append(f"g{k} AS ({grids[k]})")
        parts.append(f"b{k} AS (SELECT g.label, g.s, g.o, -(yy + s * s * xx + o * o - 2 * s * xy - 2 * o * y + 2 * s * o * x) AS score FROM g{k} g JOIN m USING (label) QUALIFY row_number() OVER (PARTITION BY g.label ORDER BY round(score, 12) DESC, s, o) = 1)")
    return f"WITH {', '.join(parts)} SELECT label, s, o, round(score, 6) AS score FROM b2"


@query("searched_levels", _levels_sql())
def searched_levels(spark, d):
    """For each label the slope and offset that lead best from a vector to the next one."""
    e = table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    means = e.join(after, ["vec_id", "i"]).groupBy("label").agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * x).alias("xx"), F.avg(x * y).alias("xy"), F.avg(y * y).alias("yy"))
    s, o, m = F.col("s"), F.col("o"), F.col
    error = m("yy") + s * s * m("xx") + o * o - 2 * s * m("xy") - 2 * o * m("my") + 2 * s * o * m("mx")
    out = search.search_levels(e, ["label"], {"s": (-1.0, 1.0, 0.25), "o": (-0.5, 0.5, 0.125)}, lambda g: g.join(means, "label").select("label", "s", "o", F.round(-error, 12).alias("score")), 2, 4)
    return r6(out, "score")
