"""Queries of composed operators and of geometry, over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lamina.functions import geometry as geo
from lamina.functions import semantics as sem
from lamina.operators import aggregates as agg
from lamina.operators import composites as comp
from lamina.plans.queries_native import CELLS, FIRST, INDEXED, cells, events, indexed, r6, split_by_type
from lamina.plans.registry import query, table


@query("crop", f"SELECT z, col - 16 AS col, v FROM ({CELLS}) WHERE col >= 16 AND col < 48")
def crop(spark, d):
    return geo.crop(cells(spark, d).withColumn("z0", F.lit(0)), "z0", "col", 1, 64, (0.0, 1.0, 0.25, 0.75)).select("z", "col", "v")


@query("crop_interior", f"SELECT z, col - 6 AS col, v FROM ({CELLS}) WHERE col BETWEEN 6 AND 57")
def crop_interior(spark, d):
    return geo.crop_interior(cells(spark, d).withColumn("z0", F.lit(0)), "z0", "col", 1, 64, 0.1).select("z", "col", "v")


@query("orient", f"SELECT z, col % 8 AS \"row\", col // 8 AS col, v FROM ({CELLS})")
def orient(spark, d):
    """8 x 8 images turned three times and mirrored."""
    c = cells(spark, d).select("z", F.floor(F.col("col") / 8).alias("row"), (F.col("col") % 8).alias("c"), "v")
    return geo.orient(c, "row", "c", 8, 8, 3, True).select("z", "row", F.col("c").alias("col"), "v")


@query("standardise", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS z FROM events")
def standardise(spark, d):
    return r6(geo.standardise(events(spark, d).select("event_id", F.col("value").alias("z")), ["z"])[0], "z")


@query("affine_from_points", """
WITH p AS (SELECT event_type AS k, value AS x, CAST(user_id AS DOUBLE) AS y, 2 * value + user_id AS u, CAST(event_id AS DOUBLE) AS v FROM events),
m AS (SELECT k, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM p GROUP BY k),
s AS (SELECT p.k, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, sum((x-mx)*(x-mx)) AS xx, sum((y-my)*(y-my)) AS yy, sum((x-mx)*(y-my)) AS xy, sum((x-mx)*(u-mu)) AS xu, sum((y-my)*(u-mu)) AS yu, sum((x-mx)*(v-mv)) AS xv, sum((y-my)*(v-mv)) AS yv FROM p JOIN m ON m.k = p.k GROUP BY p.k)
SELECT k, round((xu*yy - yu*xy) / (xx*yy - xy*xy), 5) AS ax, round((yu*xx - xu*xy) / (xx*yy - xy*xy), 5) AS ay, round((xv*yy - yv*xy) / (xx*yy - xy*xy), 3) AS bx, round((yv*xx - xv*xy) / (xx*yy - xy*xy), 3) AS by_ FROM s""")  # fmt: skip
def affine_from_points(spark, d):
    p = events(spark, d).select(F.col("event_type").alias("k"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), (2 * F.col("value") + F.col("user_id")).alias("u"), F.col("event_id").cast("double").alias("v"))
    a = geo.affine_from_points(p, ["k"])
    return a.select("k", F.round("ax", 5).alias("ax"), F.round("ay", 5).alias("ay"), F.round("bx", 3).alias("bx"), F.round("by", 3).alias("by_"))


@query("winding_of", """
WITH e AS (SELECT event_id, value AS r, (user_id % 100) / 100.0 * 2 * pi() AS phi FROM events), k AS (SELECT unnest(range(12)) AS k)
SELECT event_id, CAST(k AS INT) AS winding FROM (SELECT event_id, k, abs(r - (20.0 + 40.0 * (phi / (2 * pi()) + k))) AS err FROM e CROSS JOIN k) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(err, 9), k) = 1""")  # fmt: skip
def winding_of(spark, d):
    phi = (F.col("user_id") % 100) / 100.0 * (2 * math.pi)
    return events(spark, d).select("event_id", geo.winding_of(F.col("value"), phi, 20.0, 40.0, 12).alias("winding"))


@query("normals", f"""
WITH e AS ({INDEXED}), g AS (SELECT user_id, i, coalesce(lead(i) OVER w, i) - coalesce(lag(i) OVER w, i) AS dx, coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value) AS dy FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i, round(0.0 - dy / greatest(sqrt(dx * dx + dy * dy), 1e-12), 6) AS nx, round(dx / greatest(sqrt(dx * dx + dy * dy), 1e-12), 6) AS ny FROM g""")  # fmt: skip
def normals(spark, d):
    return r6(geo.normals(indexed(spark, d), ["user_id"], "i", "i", "value").select("user_id", "i", "nx", "ny"), "nx", "ny")


@query("fourier", "SELECT event_id, round(1.5 + 0.5 * cos(value / 50) - 0.25 * sin(value / 50) + 0.1 * cos(2 * (value / 50)) + 0.2 * sin(2 * (value / 50)), 6) AS r FROM events")
def fourier(spark, d):
    return r6(events(spark, d).select("event_id", geo.fourier(F.col("value") / 50, [1.5, 0.5, -0.25, 0.1, 0.2]).alias("r")), "r")


@query("synthetic_patterns", """
SELECT event_id, round(event_id % 256 / 255.0, 6) AS gradient, CAST(floor(event_id % 256 / 16.0) AS INT) % 2 AS bars FROM events""")  # fmt: skip
def synthetic_patterns(spark, d):
    p = lambda kind: geo.patterns(kind, F.col("event_id") % 256, F.lit(0), 256, 1)
    return r6(table(spark, d, "events").select("event_id", p("gradient").alias("gradient"), p("bars").cast("int").alias("bars")), "gradient")


@query("windows", "SELECT vec_id, s AS start, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding[s + 1 : s + 16]]), 5) AS w FROM (SELECT vec_id, embedding, unnest([0, 16, 32, 48]) AS s FROM embeddings)")
def windows(spark, d):
    w = geo.windows(table(spark, d, "embeddings"), ["vec_id"], "embedding", F.sequence(F.lit(0), F.lit(60), F.lit(16)), 16)
    return w.select("vec_id", "start", F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("w"))


@query("corrupted_windows", """
WITH s AS (SELECT vec_id, embedding AS e, CAST(floor(CAST('0x' || substr(md5(vec_id || '|' || i || '|5'), 1, 8) AS BIGINT) / 4294967296.0 * 49) AS INT) AS start FROM embeddings CROSS JOIN (SELECT unnest(range(3)) AS i))
SELECT vec_id, start, true AS reverse, true AS roll, true AS swap, true AS shuffle, round(CAST(e[start + 16] AS DOUBLE), 6) AS reversed_first, round(CAST(e[start + 9] AS DOUBLE), 6) AS swapped_first FROM s""")  # fmt: skip
def corrupted_windows(spark, d):
    """Windows at hashed places, damaged in four ways; each keeps its values as a set."""
    e = table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    w = geo.windows(e, ["vec_id"], "embedding", geo.hashed_starts(3, F.size("embedding"), 16, 5, F.col("vec_id")), 16)
    modes = ["reverse", "roll", "swap", "shuffle"]
    same = [(F.array_sort(geo.corrupt(F.col("window"), m, 3, F.col("vec_id"))) == F.array_sort("window")).alias(m) for m in modes]
    first = [F.round(geo.corrupt(F.col("window"), m, 3, F.col("vec_id"))[0], 6).alias(n) for m, n in (("reverse", "reversed_first"), ("swap", "swapped_first"))]
    return w.select("vec_id", "start", *same, *first)


@query("motion_masks", """
WITH n AS (SELECT label, vec_id, embedding AS e, coalesce(lag(embedding) OVER w, embedding) AS b, coalesce(lead(embedding) OVER w, embedding) AS a FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
m AS (SELECT label, vec_id, [greatest(abs(CAST(e[i] AS DOUBLE) - b[i]), abs(CAST(e[i] AS DOUBLE) - a[i])) FOR i IN range(1, 65)] AS m FROM n)
SELECT label, vec_id, round(list_max(m), 6) AS top, round(list_sum(m), 5) AS total FROM m""")  # fmt: skip
def motion_masks(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("px"))
    m = geo.neighbour_change(e, ["label"], "vec_id", "px", 0.0)
    return m.select("label", "vec_id", F.round(F.array_max("motion"), 6).alias("top"), F.round(F.aggregate("motion", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


# ---- composed operators

LAYERS = "SELECT CAST(n_nationkey % 8 AS INT) AS bin, n_nationkey AS k, 20.0 * n_nationkey AS r, 30.0 AS thick FROM nation"


@query("assign_layers", f"""
WITH l AS ({LAYERS}), p AS (SELECT event_id, value AS r, CAST(floor(event_id % 360 / 360.0 * 8) AS INT) AS bin FROM events),
j AS (SELECT p.event_id, l.k, abs(p.r - l.r) AS gap, row_number() OVER (PARTITION BY event_id ORDER BY abs(p.r - l.r), l.k) AS n FROM p JOIN l ON l.bin = p.bin AND abs(p.r - l.r) <= greatest(3.0, 0.3 * thick))
SELECT event_id, k, round(gap, 6) AS gap FROM j WHERE n = 1""")  # fmt: skip
def assign_layers(spark, d):
    layers = table(spark, d, "nation").select((F.col("n_nationkey") % 8).cast("int").alias("bin"), F.col("n_nationkey").alias("k"), (20.0 * F.col("n_nationkey")).alias("r"), F.lit(30.0).alias("thick"))
    p = events(spark, d).select("event_id", F.col("value").alias("r"), ((F.col("event_id") % 360 + 1e-9) / 360.0 * (2 * math.pi)).alias("theta"))
    return r6(comp.assign_layers(p, layers, [], 8).select("event_id", "k", "gap"), "gap")


@query("bin_to_boundaries", """
SELECT e.event_id, (SELECT count(*) FROM (SELECT 20.0 * n_nationkey AS r FROM nation) b WHERE b.r <= e.value) AS k FROM events e""")  # fmt: skip
def bin_to_boundaries(spark, d):
    b = table(spark, d, "nation").select((20.0 * F.col("n_nationkey")).alias("r"))
    return comp.bin_to_boundaries(events(spark, d).select("event_id", "value"), b, [], "value").select("event_id", "k")


def _clipped_sql() -> str:
    """Three rounds of a line refitted to what lies near it, for both coordinates, then interpolation."""
    fit = lambda c, used: f"regr_intercept({c}, CAST(z AS DOUBLE)){used} OVER u + regr_slope({c}, CAST(z AS DOUBLE)){used} OVER u * z"
    parts = [f"e AS ({INDEXED}), t AS (SELECT user_id, i AS z, value AS cx, value * 0.5 + i AS cy, true AS ux, true AS uy FROM e)"]
    last = "t"
    for k in range(1, 4):
        line = ", ".join(f"abs({c} - ({fit(c, f' FILTER (WHERE u{x})')})) AS d{x}" for c, x in (("cx", "x"), ("cy", "y")))
        parts.append(f"f{k} AS (SELECT *, {line} FROM {last} WINDOW u AS (PARTITION BY user_id))")
        used = ", ".join(f"d{x} <= greatest(1.4826 * median(d{x}) FILTER (WHERE u{x}) OVER u, 0.5) AS u{x}" for x in "xy")
        parts.append(f"g{k} AS (SELECT user_id, z, cx, cy, {used} FROM f{k} WINDOW u AS (PARTITION BY user_id))")
        last = f"g{k}"
    parts.append(f"k AS MATERIALIZED (SELECT *, (ux AND uy) OR avg(CAST(ux AND uy AS INT)) OVER (PARTITION BY user_id) < 0.5 AS keep FROM {last})")
    ends = "SELECT k.*, max({'z': a.z, 'x': a.cx, 'y': a.cy}) FILTER (WHERE a.z <= k.z) AS l, min({'z': a.z, 'x': a.cx, 'y': a.cy}) FILTER (WHERE a.z >= k.z) AS r FROM k LEFT JOIN k a ON a.user_id = k.user_id AND a.keep GROUP BY ALL"
    parts.append(f"m AS ({ends})")
    value = lambda c: f"round(coalesce(l.{c} + (r.{c} - l.{c}) * coalesce((z - l.z) * 1.0e0 / nullif(r.z - l.z, 0), 0), l.{c}, r.{c}), 5) AS c{c}"
    return f"WITH {', '.join(parts)} SELECT user_id, z, {value('x')}, {value('y')}, CASE WHEN keep THEN 'measured' ELSE 'interpolated' END AS origin FROM m"


@query("refit_centres", _clipped_sql())
def refit_centres(spark, d):
    c = indexed(spark, d).select("user_id", F.col("i").alias("z"), F.col("value").alias("cx"), (F.col("value") * 0.5 + F.col("i")).alias("cy"))
    out = comp.refit_centres(c, ["user_id"], "z", ["cx", "cy"], 3, 1.0)
    return out.withColumns({"z": F.col("z").cast("long"), **{x: F.round(x, 5) for x in ("cx", "cy")}})


@query("ladder_gaps", """
WITH r AS (SELECT label, median(CAST(embedding[1] AS DOUBLE)) AS r FROM embeddings GROUP BY label) SELECT label, round(r, 6) AS r, round(lead(r) OVER (ORDER BY label) - r, 6) AS gap FROM r""")  # fmt: skip
def ladder_gaps(spark, d):
    e = table(spark, d, "embeddings").select(F.lit(0).alias("g"), "label", F.col("embedding")[0].cast("double").alias("r"))
    return r6(comp.ladder_gaps(e, ["g"], "label", "r").select("label", "r", "gap"), "r", "gap")


@query("crossings", f"""
WITH c AS ({CELLS}), p AS (SELECT label, a.col, b.v - a.v AS g FROM c a JOIN (SELECT z - 1 AS z, col, v FROM c) b USING (z, col))
SELECT label, col, count(*) FILTER (WHERE g < 0.2) AS close, count(*) FILTER (WHERE g < 0) AS crossed, count(*) AS pairs FROM p GROUP BY label, col""")  # fmt: skip
def crossings(spark, d):
    c = cells(spark, d).select("label", "z", "col", "v")
    near = c.select((F.col("z") - 1).alias("z"), "col", F.col("v").alias("n"))
    own = c.join(near, ["z", "col"]).select("label", F.lit(0).alias("w"), F.struct("z", "col").alias("b"), F.col("v"), "n")
    both = own.select("label", "w", "b", "v").union(own.select("label", F.lit(1), "b", "n"))
    each = comp.crossings(both, ["label"], "w", "b", "v", 0.2)
    return each.groupBy("label", F.col("b.col").alias("col")).agg(F.sum("close").alias("close"), F.sum("crossed").alias("crossed"), F.sum("pairs").alias("pairs"))


@query("walk_quality", f"""
WITH e AS ({INDEXED}), s AS (SELECT user_id, i, i - lag(i) OVER w AS dx, value - lag(value) OVER w AS dy FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)),
a AS (SELECT *, sqrt(dx * dx + dy * dy) AS l, atan2(dy, dx) AS a FROM s), t AS (SELECT *, a - lag(a) OVER (PARTITION BY user_id ORDER BY i) AS da FROM a)
SELECT user_id, count(*) AS points, count(*) FILTER (WHERE l > 100) AS jumps, count(*) FILTER (WHERE abs(da) > 3.0 AND abs(da) <= pi() OR abs(da) > pi() AND 2 * pi() - abs(da) > 3.0) AS kinks, round(coalesce(sum(l), 0), 4) AS length FROM t GROUP BY user_id""")  # fmt: skip
def walk_quality(spark, d):
    return comp.walk_quality(indexed(spark, d), ["user_id"], "i", "i", "value", 100.0, 3.0).withColumn("length", F.round("length", 4))


@query("cut_cells", """
WITH b AS (SELECT user_id, event_id AS lo, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS cell, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS hi FROM events WHERE value > 60)
SELECT e.user_id, e.event_id, b.cell FROM events e JOIN b ON b.user_id = e.user_id AND e.event_id >= b.lo AND e.event_id < b.hi""")  # fmt: skip
def cut_cells(spark, d):
    e = events(spark, d)
    bounds = e.where("value > 60").select("user_id", F.col("event_id").alias("at"))
    return comp.cut_cells(e.select("user_id", "event_id"), bounds, ["user_id"], "event_id", 200.0).select("user_id", "event_id", "cell")


@query("template_scores", f"""
WITH c AS ({CELLS}), t AS (SELECT label, col, median(v) AS t FROM c GROUP BY label, col) SELECT c.label, c.z, round(corr(c.v, t.t), 5) AS score FROM c JOIN t ON t.label = c.label AND t.col = c.col GROUP BY c.label, c.z""")  # fmt: skip
def template_scores(spark, d):
    c = cells(spark, d)
    t = comp.template(c, ["label"], "z", "col", "v")
    return comp.template_score(c, t, ["label"], "z", "col", "v").select("label", "z", F.round("score", 5).alias("score"))


@query("merge_edges", """
WITH n AS (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) >= 40 THEN 1 ELSE 0 END AS nw FROM events),
g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM n)
SELECT user_id, round(avg(event_id), 6) AS event_id, count(*) AS n FROM g GROUP BY user_id, g""")  # fmt: skip
def merge_edges(spark, d):
    return r6(comp.merge_edges(events(spark, d).select("user_id", "event_id"), ["user_id"], "event_id", 40), "event_id")


@query("fuse_rails", f"""
WITH e AS ({INDEXED}), a AS (SELECT user_id, i, value AS v FROM e WHERE event_type <> {FIRST}), b AS (SELECT user_id, i, value * 0.5 + i AS v FROM e),
d AS (SELECT 'a' AS s, user_id, lag(v) OVER w - 2 * v + lead(v) OVER w AS d FROM a WINDOW w AS (PARTITION BY user_id ORDER BY i) UNION ALL SELECT 'b', user_id, lag(v) OVER w - 2 * v + lead(v) OVER w FROM b WINDOW w AS (PARTITION BY user_id ORDER BY i)),
m AS (SELECT s, user_id, median(d) AS m FROM d WHERE d IS NOT NULL GROUP BY ALL), n AS (SELECT d.s, d.user_id, 1.4826 * median(abs(d - m)) / sqrt(6.0) AS n FROM d JOIN m ON m.s = d.s AND m.user_id = d.user_id WHERE d IS NOT NULL GROUP BY ALL),
w AS (SELECT x.user_id, 1 / greatest(power(x.n, 2), 1e-12) AS wa, 1 / greatest(power(y.n, 2), 1e-12) AS wb FROM n x JOIN n y ON y.user_id = x.user_id AND x.s = 'a' AND y.s = 'b')
SELECT b.user_id, b.i, round(CASE WHEN a.v IS NULL THEN b.v ELSE (a.v * wa + b.v * wb) / (wa + wb) END, 5) AS v, CASE WHEN a.v IS NULL THEN 'second' ELSE 'both' END AS origin FROM b LEFT JOIN a ON a.user_id = b.user_id AND a.i = b.i LEFT JOIN w ON w.user_id = b.user_id""")  # fmt: skip
def fuse_rails(spark, d):
    e = indexed(spark, d).select("user_id", "i", F.col("value").alias("v"), "event_type")
    a = split_by_type(e)[1].select("user_id", "i", "v")
    b = e.select("user_id", "i", (F.col("v") * 0.5 + F.col("i")).alias("v"))
    return comp.fuse_rails(a, b, ["user_id"], "i", "v").withColumn("v", F.round("v", 5))


@query("residual_agreement", f"""
WITH e AS ({INDEXED}), f AS (
  SELECT a.user_id, a.i, any_value(a.value) AS y, any_value(sin(a.value) * 9 + a.i) AS y2, count(b.i) AS n, regr_intercept(b.value, CAST(b.i - a.i AS DOUBLE)) AS at0, regr_intercept(sin(b.value) * 9 + b.i, CAST(b.i - a.i AS DOUBLE)) AS at02
  FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.i <> a.i AND abs(a.i - b.i) <= 3 GROUP BY a.user_id, a.i)
SELECT user_id, round(corr(y - at0, y2 - at02), 5) AS corr, count(*) AS n FROM f WHERE n >= 3 GROUP BY user_id""")  # fmt: skip
def residual_agreement(spark, d):
    e = indexed(spark, d).select("user_id", "i", F.col("value").alias("v"))
    r = comp.residual_agreement(e, e.withColumn("v", F.sin("v") * 9 + F.col("i")), ["user_id"], "i", "v")
    return r.withColumn("corr", F.round("corr", 5))


@query("hold_out_error", f"""
WITH e AS ({INDEXED}), k AS (SELECT user_id, i, value, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS k FROM e),
f AS (SELECT user_id, arg_max(value, i) AS l, regr_slope(value, i) AS a, regr_intercept(value, i) AS b FROM k WHERE k > 10 GROUP BY user_id)
SELECT k.user_id, round(avg(abs(value - l)), 5) AS hold, round(avg(abs(value - a * i - b)), 5) AS line FROM k JOIN f ON f.user_id = k.user_id WHERE k <= 10 GROUP BY k.user_id""")  # fmt: skip
def hold_out_error(spark, d):
    h = comp.hold_out_error(indexed(spark, d), ["user_id"], "i", "value", 10)
    return h.select("user_id", F.round("hold", 5).alias("hold"), F.round("line", 5).alias("line"))


@query("ring_coverage", f"SELECT label, CAST(col // 4 AS INT) AS ring, round(avg(CAST(v > 0 AS INT)), 6) AS share, count(*) AS n FROM ({CELLS}) GROUP BY ALL")
def ring_coverage(spark, d):
    return r6(comp.coverage_by_ring(cells(spark, d), ["label"], F.col("col"), F.col("v") > 0, 4.0), "share")


@query("edge_scatter", """
WITH s AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events),
m AS (SELECT user_id, median(value) AS m, median(d) AS md, count(*) AS n, count(d) AS nd FROM s GROUP BY user_id)
SELECT s.user_id, round(CASE WHEN any_value(n) >= 3 THEN 1.4826 * median(abs(value - m)) END + 1e-7, 4) AS scatter, round(CASE WHEN any_value(nd) >= 3 THEN 1.4826 * median(abs(d - md)) END + 1e-7, 4) AS jitter FROM s JOIN m ON m.user_id = s.user_id GROUP BY s.user_id""")  # fmt: skip
def edge_scatter(spark, d):
    e = comp.edge_scatter(events(spark, d), ["user_id"], "event_id", "value")
    return e.select("user_id", F.round(F.col("scatter") + 1e-7, 4).alias("scatter"), F.round(F.col("jitter") + 1e-7, 4).alias("jitter"))


@query("class_shares", "SELECT lang, round(avg(CAST(quality = 0 AS INT)), 6) AS class_0, round(avg(CAST(quality = 1 AS INT)), 6) AS class_1, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def class_shares(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return r6(comp.class_shares(j, ["lang"], "quality", [0, 1]), "class_0", "class_1")


@query("prediction_errors", f"""
WITH c AS ({CELLS}), m AS (SELECT label, col, avg(v) AS m FROM c GROUP BY label, col) SELECT c.label, round(sqrt(avg(power(v - m, 2))), 6) AS rmse, round(avg(abs(v - m)), 6) AS mae, round(corr(v, m), 5) AS corr FROM c JOIN m ON m.label = c.label AND m.col = c.col GROUP BY c.label""")  # fmt: skip
def prediction_errors(spark, d):
    c = cells(spark, d)
    m = c.groupBy("label", "col").agg(F.avg("v").alias("m"))
    e = comp.normal_profile_fit(c.join(m, ["label", "col"]), ["label"], "v", "m")
    return r6(e, "rmse", "mae").withColumn("corr", F.round("corr", 5))


@query("nested_fits", f"""
WITH c AS ({CELLS}), f AS (SELECT label, regr_slope(v, col) AS a, regr_intercept(v, col) AS b FROM c GROUP BY label), r AS (SELECT c.label, c.z, v - a * col - b AS r FROM c JOIN f ON f.label = c.label),
o AS (SELECT label, z, avg(r) AS o FROM r GROUP BY label, z) SELECT r.label, round(median(abs(r)), 6) AS line, round(median(abs(r - o)), 6) AS "free" FROM r JOIN o ON o.label = r.label AND o.z = r.z GROUP BY r.label""")  # fmt: skip
def nested_fits(spark, d):
    return r6(comp.nested_fit_residuals(cells(spark, d), ["label"], "z", "col", "v"), "line", "free")


@query("weighted_centroid", f"SELECT z, round(sum(col * abs(v)) / nullif(sum(abs(v)), 0), 6) AS centroid FROM ({CELLS}) GROUP BY z")
def weighted_centroid(spark, d):
    return r6(comp.weighted_centroid(cells(spark, d).withColumn("w", F.abs("v")), ["z"], "col", "w"), "centroid")


@query("baseline_centroid", f"""
WITH c AS ({CELLS}), b AS (SELECT z, quantile_cont(v, 0.1) AS b FROM c GROUP BY z) SELECT c.z, round(sum(col * greatest(v - b, 0)) / nullif(sum(greatest(v - b, 0)), 0), 5) AS centroid FROM c JOIN b ON b.z = c.z GROUP BY c.z""")  # fmt: skip
def baseline_centroid(spark, d):
    return comp.baseline_centroid(cells(spark, d), ["z"], "col", "v").withColumn("centroid", F.round("centroid", 5))


@query("equalise", """
WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type), b AS (SELECT e.event_id, e.event_type, CAST(least(floor((value - lo) / (hi - lo) * 32), 31) AS INT) AS b FROM events e JOIN s ON s.event_type = e.event_type),
h AS (SELECT event_type, b, sum(count(*)) OVER (PARTITION BY event_type ORDER BY b) / CAST(sum(count(*)) OVER (PARTITION BY event_type) AS DOUBLE) AS q FROM b GROUP BY event_type, b)
SELECT b.event_id, round(q, 6) AS equalised FROM b JOIN h ON h.event_type = b.event_type AND h.b = b.b""")  # fmt: skip
def equalise(spark, d):
    return r6(comp.equalise(events(spark, d), ["event_type"], "value", 32).select("event_id", "equalised"), "equalised")


@query("mad_gate", """
WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY event_type), s AS (SELECT e.event_type, 1.4826 * median(abs(value - m)) AS s FROM events e JOIN m ON m.event_type = e.event_type GROUP BY e.event_type)
SELECT event_id FROM events e JOIN m ON m.event_type = e.event_type JOIN s ON s.event_type = e.event_type WHERE abs(value - m) <= 0.8 * s""")  # fmt: skip
def mad_gate(spark, d):
    return comp.mad_gate(events(spark, d), ["event_type"], "value", 0.8).select("event_id")


@query("angle_bins", """
WITH p AS (SELECT event_type, value / 490.02 * 2 * pi() AS t, CAST(user_id AS DOUBLE) AS r FROM events)
SELECT event_type, CAST(least(floor(t / (2 * pi() / 36)), 35) AS INT) AS bin, median(r) AS r, count(*) AS n FROM p WHERE t <= 2 * pi() GROUP BY ALL""")  # fmt: skip
def angle_bins(spark, d):
    p = events(spark, d).select("event_type", (F.col("value") / 490.02 * 2 * math.pi).alias("t"), F.col("user_id").cast("double").alias("r"))
    return comp.smooth_bins(p, ["event_type"], "t", "r", 36)


@query("spiral_cloud", """
WITH p AS (SELECT event_id, event_id % 4 AS k, (value / 490.02 * 2 * pi() - 1.0) AS a FROM events), w AS (SELECT *, a - 2 * pi() * floor(a / (2 * pi())) AS t FROM p)
SELECT event_id, round(t + k * 2 * pi(), 6) AS phi FROM w WHERE t BETWEEN 0.1 AND 2 * pi() - 0.1""")  # fmt: skip
def spiral_cloud(spark, d):
    p = events(spark, d).select("event_id", (F.col("event_id") % 4).alias("k"), (F.col("value") / 490.02 * 2 * math.pi).alias("theta"))
    return r6(geo.spiral_cloud(p, "k", "theta", 1.0, 0.1).select("event_id", "phi"), "phi")


@query("wrapped_angles", "SELECT event_id, round((value + pi()) - 2 * pi() * floor((value + pi()) / (2 * pi())) - pi(), 6) AS a FROM events")
def wrapped_angles(spark, d):
    return r6(events(spark, d).select("event_id", sem.wrap_angle(F.col("value")).alias("a")), "a")


@query("fixed_scale", f"SELECT z, col, CAST(round_even(least(greatest((v + 3) / 6, 0), 1) * 255, 0) AS INT) AS u8 FROM ({CELLS})")
def fixed_scale(spark, d):
    return cells(spark, d).select("z", "col", comp.fixed_scale(F.col("v"), -3.0, 3.0).alias("u8"))


@query("even_sample", "SELECT p AS place, e.event_id, value FROM (SELECT p, CAST(round_even(p * ((SELECT max(event_id) FROM events)) / 99.0, 0) AS BIGINT) AS event_id FROM (SELECT unnest(range(100)) AS p)) q JOIN events e ON e.event_id = q.event_id")
def even_sample(spark, d):
    e = events(spark, d).select("event_id", "value")
    n = e.agg(F.max("event_id")).first()[0] + 1
    return geo.even_sample(e, "event_id", n, 100)


@query("stacked_union", "SELECT c_custkey AS id, c_acctbal AS v, 'c' AS part FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 's' FROM supplier")
def stacked_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.lit("c").alias("part"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"), F.lit("s").alias("part")))


@query("summary_by_group", "SELECT label, 'v' AS metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, count(*) AS n FROM (" + CELLS + ") GROUP BY label")
def summary_by_group(spark, d):
    return r6(agg.metric_summary(cells(spark, d), ["label"], ["v"]), "mean", "median")
