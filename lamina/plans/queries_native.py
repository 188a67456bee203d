"""Queries of DataFrame operators over the driver's tables. Events play ordered signals of users,
embeddings a strip of array rows, labels and documents a segmentation to be scored, lineitem
scattered samples. Floats are rounded so that equal results compare equal."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import semantics as sem
from lamina.operators import aggregates as agg
from lamina.operators import interp, matching, ordered
from lamina.plans.registry import query, table


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """embeddings in long form: z, col, v, label."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("z"), "label", F.posexplode("embedding").alias("col", "v")).withColumn("v", F.col("v").cast("double"))


CELLS = "SELECT vec_id AS z, label, unnest(range(len(embedding))) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
INDEXED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events"


def indexed(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("i", F.row_number().over(sem.ordered(["user_id"], "event_id")) - 1)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Two predicted classes for each labelled document, from its length, and the true ones."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select("source", (F.col("n_chars") > 1500).cast("int").alias("pred"), "quality")


@query("segmentation_score", """
WITH p AS (SELECT source, CAST(n_chars > 1500 AS INT) AS pred, quality FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, cls, count(*) FILTER (WHERE pred = cls AND quality = cls) AS tp, count(*) FILTER (WHERE pred = cls AND quality <> cls) AS fp, count(*) FILTER (WHERE pred <> cls AND quality = cls) AS fn FROM p CROSS JOIN (SELECT unnest([0, 1]) AS cls) GROUP BY ALL)
SELECT source, cls, tp, fp, fn, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS dice, round(1.0 * tp / nullif(tp + fp + fn, 0), 6) AS iou, round(1.0 * tp / nullif(tp + fp, 0), 6) AS "precision", round(1.0 * tp / nullif(tp + fn, 0), 6) AS recall FROM c""")  # fmt: skip
def segmentation_score(spark, d):
    return r6(agg.scores(agg.confusion(predictions(spark, d), ["source"], "pred", "quality", [0, 1])), *agg.METRICS)


@query("segmentation_macro", """
WITH p AS (SELECT source, CAST(n_chars > 1500 AS INT) AS pred, quality FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, cls, count(*) FILTER (WHERE pred = cls AND quality = cls) AS tp, count(*) FILTER (WHERE pred = cls AND quality <> cls) AS fp, count(*) FILTER (WHERE pred <> cls AND quality = cls) AS fn FROM p CROSS JOIN (SELECT unnest([0, 1]) AS cls) GROUP BY ALL),
s AS (SELECT cls, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS dice, 1.0 * tp / nullif(tp + fp + fn, 0) AS iou, 1.0 * tp / nullif(tp + fp, 0) AS pr, 1.0 * tp / nullif(tp + fn, 0) AS re FROM c),
m AS (SELECT cls, avg(dice) AS dice, avg(iou) AS iou, avg(pr) AS pr, avg(re) AS re FROM s GROUP BY cls)
SELECT round(avg(dice), 6) AS dice, round(avg(iou), 6) AS iou, round(avg(pr), 6) AS "precision", round(avg(re), 6) AS recall FROM m""")  # fmt: skip
def segmentation_macro(spark, d):
    s = agg.scores(agg.confusion(predictions(spark, d), ["source"], "pred", "quality", [0, 1]))
    return r6(agg.macro(s, []), *agg.METRICS)


@query("missing_pairs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_pairs(spark, d):
    return matching.pair_exact(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), ["doc_id"])[1]


@query("fold_assignment", """
SELECT o_custkey, min(f) AS fold, count(*) AS n FROM (SELECT o_custkey, o_custkey % 5 AS f FROM orders) GROUP BY o_custkey""")  # fmt: skip
def fold_assignment(spark, d):
    """Group-aware folds: all items of a parent share one."""
    from lamina.sources.splits import grouped_folds

    return grouped_folds(table(spark, d, "orders"), "o_custkey", 5, hashed=False).groupBy("o_custkey").agg(F.min("fold").alias("fold"), F.count("*").alias("n"))


@query("hashed_folds", """
SELECT o_custkey, CAST(floor(CAST('0x' || substr(md5(o_custkey || '|42'), 1, 8) AS BIGINT) / 4294967296.0 * 5) AS INT) AS fold, count(*) AS n FROM orders GROUP BY o_custkey""")  # fmt: skip
def hashed_folds(spark, d):
    from lamina.sources.splits import grouped_folds

    return grouped_folds(table(spark, d, "orders"), "o_custkey", 5).groupBy("o_custkey").agg(F.min("fold").alias("fold"), F.count("*").alias("n"))


RUNS = """
WITH e AS (SELECT *, value > 50 AS hot, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
s AS (SELECT *, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS g FROM e WHERE hot),
r AS (SELECT user_id, g, min(p) - 1 AS lo, max(p) - 1 AS hi, count(*) AS n FROM s GROUP BY ALL)
"""


@query("runs", RUNS + "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY lo) - 1 AS run_no, lo, hi, n FROM r WHERE n >= 2")
def runs(spark, d):
    return ordered.runs(indexed(spark, d), ["user_id"], "i", F.col("value") > 50, 2, count_samples=True)


@query("runs_by_extent", RUNS + "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY lo) - 1 AS run_no, lo, hi, n, (lo + hi) / 2.0 AS mid FROM r WHERE hi - lo >= 2")
def runs_by_extent(spark, d):
    return ordered.run_midpoints(ordered.runs(indexed(spark, d), ["user_id"], "i", F.col("value") > 50, 2))


@query("kth_run_profile", f"""
WITH e AS (SELECT *, v > 0 AS hot FROM ({CELLS})),
s AS (SELECT *, col - row_number() OVER (PARTITION BY z ORDER BY col) AS g FROM e WHERE hot),
r AS (SELECT label, z, g, min(col) AS lo, max(col) AS hi FROM s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY lo) - 1 AS k, count(*) OVER (PARTITION BY z) AS runs FROM r),
votes AS (SELECT label, runs, count(DISTINCT z) AS rays FROM k GROUP BY ALL),
mode AS (SELECT label, runs FROM votes QUALIFY row_number() OVER (PARTITION BY label ORDER BY rays DESC, runs) = 1)
SELECT label, k, median((lo + hi) / 2.0) AS r, count(*) AS rays FROM k JOIN mode USING (label, runs) GROUP BY label, k""")  # fmt: skip
def kth_run_profile(spark, d):
    t = ordered.runs(cells(spark, d), ["label", "z"], "col", F.col("v") > 0)
    return ordered.kth_run_profile(t, ["label"], "z")


@query("circular_runs", f"""
WITH e AS (SELECT z, col, v > 0 AS hot FROM ({CELLS})),
tripled AS (SELECT z, col + 64 * t AS c, hot FROM e CROSS JOIN (SELECT unnest([0, 1, 2]) AS t)),
s AS (SELECT *, c - row_number() OVER (PARTITION BY z ORDER BY c) AS g FROM tripled WHERE hot),
r AS (SELECT z, g, min(c) AS lo, max(c) AS hi, count(*) AS n FROM s GROUP BY ALL),
whole AS (SELECT z, 0 AS lo, 63 AS hi, 64 AS n FROM r WHERE n = 192)
SELECT z, row_number() OVER (PARTITION BY z ORDER BY lo) - 1 AS run_no, lo, hi, n FROM (SELECT z, lo - 64 AS lo, hi - 64 AS hi, n FROM r WHERE lo >= 64 AND lo < 128 UNION ALL SELECT * FROM whole)""")  # fmt: skip
def circular_runs(spark, d):
    return ordered.circular_runs(cells(spark, d), ["z"], "col", F.col("v") > 0, 64)


@query("infill_spacing", """
WITH g AS (SELECT user_id, CAST(event_id AS DOUBLE) AS p, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM events),
m AS (SELECT user_id, median(nx - p) AS med FROM g GROUP BY user_id),
k AS (SELECT g.user_id, p, nx, CAST(greatest(coalesce(round_even((nx - p) / nullif(med, 0), 0) - 1, 0), 0) AS INT) AS k FROM g JOIN m ON g.user_id = m.user_id)
SELECT user_id, round(CASE WHEN i = 0 THEN p ELSE p + (nx - p) * i / (k + 1) END, 6) AS event_id, i > 0 AS filled FROM (SELECT *, unnest(range(k + 1)) AS i FROM k)""")  # fmt: skip
def infill_spacing(spark, d):
    return r6(ordered.infill_spacing(events(spark, d), ["user_id"], "event_id"), "event_id")


@query("infill_spacing_local", """
WITH g AS (SELECT user_id, CAST(event_id AS DOUBLE) AS p, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM events),
w AS (SELECT *, list_concat(coalesce(list(nx - p) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []), coalesce(list(nx - p) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), [])) AS near FROM g),
m AS (SELECT *, list_median(list_filter(near, lambda x: x IS NOT NULL)) AS med FROM w),
e AS (SELECT *, CAST(greatest(coalesce(round_even((nx - p) / nullif(med, 0), 0) - 1, 0), 0) AS INT) AS e FROM m),
k AS (SELECT user_id, p, nx, CASE WHEN e > 3 THEN 0 ELSE e END AS k FROM e)
SELECT user_id, round(CASE WHEN i = 0 THEN p ELSE p + (nx - p) * i / (k + 1) END, 6) AS event_id, i > 0 AS filled FROM (SELECT *, unnest(range(k + 1)) AS i FROM k)""")  # fmt: skip
def infill_spacing_local(spark, d):
    return r6(ordered.infill_spacing_local(events(spark, d), ["user_id"], "event_id"), "event_id")


@query("midpoint_insertion", """
WITH c AS (SELECT conv_id, turn AS t, CAST(length(text) AS DOUBLE) AS v FROM conversations WHERE role = 'user'),
n AS (SELECT *, lead(t) OVER (PARTITION BY conv_id ORDER BY t) AS nt, lead(v) OVER (PARTITION BY conv_id ORDER BY t) AS nv FROM c)
SELECT conv_id, t AS turn, v AS size, false AS filled FROM n UNION ALL SELECT conv_id, t + 1, (v + nv) / 2, true FROM n WHERE nt - t = 2""")  # fmt: skip
def midpoint_insertion(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.char_length("text").cast("double").alias("size"))
    return ordered.midpoints_at_skips(c, ["conv_id"], "turn", "size")


@query("heal_outliers", """
WITH m AS (SELECT user_id, event_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS med FROM events),
s AS (SELECT user_id, 1.4826 * median(abs(value - med)) AS sc FROM m GROUP BY user_id),
o AS (SELECT m.*, abs(value - med) > 1.5 * sc AS outlier FROM m JOIN s ON m.user_id = s.user_id),
k AS (SELECT *, last_value(CASE WHEN NOT outlier THEN event_id END IGNORE NULLS) OVER a AS t0, last_value(CASE WHEN NOT outlier THEN value END IGNORE NULLS) OVER a AS v0,
  first_value(CASE WHEN NOT outlier THEN event_id END IGNORE NULLS) OVER b AS t1, first_value(CASE WHEN NOT outlier THEN value END IGNORE NULLS) OVER b AS v1 FROM o
  WINDOW a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, outlier, round(med, 6) AS med, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (event_id - t0) / (t1 - t0) END, 6) AS healed FROM k""")  # fmt: skip
def heal_outliers(spark, d):
    h = ordered.heal_outliers(events(spark, d), ["user_id"], "event_id", "value", 4, 1.5)
    return r6(h.select("user_id", "event_id", "outlier", "med", "healed"), "med", "healed")


@query("incremental_index", """
WITH s AS (SELECT user_id, event_id, coalesce(greatest(1.0, round_even((event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id)) / 60.0, 0)), 0.0) AS st, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events)
SELECT user_id, event_id, idx, round(event_id - f - idx * 60.0, 6) AS residual FROM (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS idx FROM s)""")  # fmt: skip
def incremental_index(spark, d):
    return r6(ordered.incremental_index(events(spark, d).select("user_id", "event_id"), ["user_id"], "event_id", 60.0), "residual")


@query("unslip", """
WITH j AS (SELECT user_id, event_id, value, coalesce(round_even((value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) / 100.0, 0), 0.0) AS jump FROM events)
SELECT user_id, event_id, round(value - 100.0 * sum(jump) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS unslipped FROM j""")  # fmt: skip
def unslip(spark, d):
    return r6(ordered.unslip(events(spark, d), ["user_id"], "event_id", "value", 100.0).select("user_id", "event_id", "unslipped"), "unslipped")


@query("leave_one_out", f"""
WITH e AS ({INDEXED}),
f AS (SELECT a.user_id, a.i, any_value(a.value) AS y, count(b.i) AS n, regr_intercept(b.value, CAST(b.i - a.i AS DOUBLE)) AS at0 FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.i <> a.i AND abs(a.i - b.i) <= 3 GROUP BY a.user_id, a.i)
SELECT user_id, i, round(CASE WHEN n >= 3 THEN y - at0 END, 6) AS residual FROM f""")  # fmt: skip
def leave_one_out(spark, d):
    return r6(ordered.leave_one_out(indexed(spark, d), ["user_id"], "i", "value").select("user_id", "i", "residual"), "residual")


@query("second_difference_noise", """
WITH d AS (SELECT user_id, lag(value) OVER w - 2 * value + lead(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
m AS (SELECT user_id, median(d) AS m FROM d WHERE d IS NOT NULL GROUP BY user_id)
SELECT d.user_id, round(1.4826 * median(abs(d - m)) / sqrt(6.0), 6) AS noise FROM d JOIN m ON d.user_id = m.user_id WHERE d IS NOT NULL GROUP BY d.user_id""")  # fmt: skip
def second_difference_noise(spark, d):
    return r6(ordered.second_difference_noise(events(spark, d), ["user_id"], "event_id", "value"), "noise")


@query("arc_length", f"""
WITH e AS ({INDEXED}), s AS (SELECT user_id, i, coalesce(sqrt(power(i - lag(i) OVER w, 2) + power(value - lag(value) OVER w, 2)), 0.0) AS st FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i, round(sum(st) OVER (PARTITION BY user_id ORDER BY i), 6) AS s FROM s""")  # fmt: skip
def arc_length(spark, d):
    return r6(ordered.arc_length(indexed(spark, d), ["user_id"], "i", "i", "value").select("user_id", "i", "s"), "s")


@query("spiral_arc_table", f"""
WITH e AS ({INDEXED}), p AS (SELECT user_id, CAST(i AS DOUBLE) AS phi, value AS r FROM e),
f AS (SELECT *, (coalesce(lead(r) OVER w, r) - coalesce(lag(r) OVER w, r)) / nullif(coalesce(lead(phi) OVER w, phi) - coalesce(lag(phi) OVER w, phi), 0) AS dr FROM p WINDOW w AS (PARTITION BY user_id ORDER BY phi)),
g AS (SELECT *, sqrt(r * r + power(coalesce(dr, 0), 2)) AS f FROM f),
h AS (SELECT *, coalesce((f + lag(f) OVER w) / 2 * (phi - lag(phi) OVER w), 0.0) AS d FROM g WINDOW w AS (PARTITION BY user_id ORDER BY phi))
SELECT user_id, phi, round(sum(d) OVER (PARTITION BY user_id ORDER BY phi), 5) AS s FROM h""")  # fmt: skip
def spiral_arc_table(spark, d):
    p = indexed(spark, d).select("user_id", F.col("i").cast("double").alias("phi"), F.col("value").alias("r"))
    return ordered.spiral_arc_table(p, ["user_id"], "phi", "r").select("user_id", "phi", F.round("s", 5).alias("s"))


@query("detrend", f"""
WITH c AS ({CELLS}),
p AS (SELECT z, unnest(range(-5, 69)) AS k FROM (SELECT DISTINCT z FROM c)),
x AS (SELECT p.z, p.k, c.v FROM p JOIN c ON c.z = p.z AND c.col = least(greatest(p.k, 0), 63)),
m AS (SELECT z, k, avg(v) OVER (PARTITION BY z ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM x),
y AS (SELECT c.z, c.col, c.v - m.m AS y FROM c JOIN m ON m.z = c.z AND m.k = c.col)
SELECT z, col, round(y - avg(y) OVER (PARTITION BY z), 6) AS flat FROM y""")  # fmt: skip
def detrend(spark, d):
    return r6(ordered.detrend(cells(spark, d), ["z"], "col", "v", 5).select("z", "col", "flat"), "flat")


@query("circular_step_response", f"""
WITH c AS ({CELLS}), t AS (SELECT z, col, col + 64 * k AS i, k, v FROM c CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k)),
s AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY z ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - quantile_cont(v, 0.5) OVER (PARTITION BY z ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS st FROM t)
SELECT z, col, round(st, 6) AS step FROM s WHERE k = 0""")  # fmt: skip
def circular_step_response(spark, d):
    return r6(ordered.step_response(cells(spark, d), ["z"], "col", "v", 5, 64).select("z", "col", "step"), "step")


@query("circular_mean_filter", f"""
WITH c AS ({CELLS}), t AS (SELECT z, col, col + 64 * k AS i, k, v FROM c CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k))
SELECT z, col, round(m, 6) AS smooth FROM (SELECT *, avg(v) OVER (PARTITION BY z ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM t) WHERE k = 0""")  # fmt: skip
def circular_mean_filter(spark, d):
    return r6(ordered.circular_mean_filter(cells(spark, d), ["z"], "col", "v", 3, 64).select("z", "col", "smooth"), "smooth")


@query("trim_leader", f"""
WITH e AS ({INDEXED}), f AS (SELECT user_id, min(i) AS f FROM e WHERE value > 400 GROUP BY user_id)
SELECT e.user_id, e.i FROM e LEFT JOIN f ON f.user_id = e.user_id WHERE f IS NULL OR i >= f""")  # fmt: skip
def trim_leader(spark, d):
    return ordered.trim_leader(indexed(spark, d), ["user_id"], "i", F.col("value"), 400).select("user_id", "i")


@query("trim_to_active", f"""
WITH e AS ({INDEXED}), f AS (SELECT user_id, min(i) AS lo, max(i) AS hi FROM e WHERE value > 420 GROUP BY user_id)
SELECT e.user_id, e.i FROM e LEFT JOIN f ON f.user_id = e.user_id WHERE lo IS NULL OR i BETWEEN lo AND hi""")  # fmt: skip
def trim_to_active(spark, d):
    return ordered.trim_to_active(indexed(spark, d), ["user_id"], "i", F.col("value") > 420).select("user_id", "i")


@query("local_extrema", f"""
WITH c AS ({CELLS}), n AS (SELECT z, col, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM c WINDOW w AS (PARTITION BY z ORDER BY col)),
l AS (SELECT *, CASE WHEN v <= coalesce(p, 'inf'::DOUBLE) AND v <= coalesce(q, 'inf'::DOUBLE) THEN v END AS low, v > coalesce(p, '-inf'::DOUBLE) AND v >= coalesce(q, '-inf'::DOUBLE) AS peak FROM n),
s AS (SELECT *, greatest(last_value(low IGNORE NULLS) OVER (PARTITION BY z ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(low IGNORE NULLS) OVER (PARTITION BY z ORDER BY col ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS base FROM l)
SELECT z, col, round(v, 6) AS v, round(v - base, 6) AS prominence FROM s WHERE peak AND coalesce(v - base, 'inf'::DOUBLE) >= 0.5""")  # fmt: skip
def local_extrema(spark, d):
    return r6(ordered.local_extrema(cells(spark, d), ["z"], "col", "v", 0.5), "v", "prominence")


@query("level_crossings", f"""
WITH c AS ({CELLS}), n AS (SELECT z, CAST(col AS DOUBLE) AS t, v, lag(CAST(col AS DOUBLE)) OVER w AS pt, lag(v) OVER w AS pv FROM c WINDOW w AS (PARTITION BY z ORDER BY col)),
x AS (SELECT z, pt + (0.1 - pv) / (v - pv) * (t - pt) AS a FROM n WHERE (pv < 0.1 AND v >= 0.1) OR (pv >= 0.1 AND v < 0.1))
SELECT z, round(min(a), 6) AS "first", round(max(a), 6) AS "last" FROM x GROUP BY z""")  # fmt: skip
def level_crossings(spark, d):
    return r6(ordered.level_crossings(cells(spark, d), ["z"], "col", "v", F.lit(0.1)), "first", "last")


@query("monotone_rail", "SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS rail FROM events")
def monotone_rail(spark, d):
    return ordered.monotone(events(spark, d), ["user_id"], "event_id", "value").select("user_id", "event_id", "rail")


@query("gap_clusters", """
WITH n AS (SELECT user_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) >= 14 THEN 1 ELSE 0 END AS nw FROM events),
c AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS c FROM n)
SELECT user_id, CAST(c AS BIGINT) AS cluster, round(median(value), 6) AS centre, count(*) AS n FROM c GROUP BY ALL""")  # fmt: skip
def gap_clusters(spark, d):
    return r6(ordered.gap_clusters(events(spark, d), ["user_id"], "value", 14.0), "centre")


@query("cdf_rank", """
SELECT event_type, event_id, round((row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1) / CAST(count(*) OVER (PARTITION BY event_type) AS DOUBLE) * 34.0, 6) AS u FROM events""")  # fmt: skip
def cdf_rank(spark, d):
    return r6(ordered.cdf_rank(events(spark, d), ["event_type"], "value", "event_id", scale=34.0).select("event_type", "event_id", "u"), "u")


@query("frame_change", """
WITH n AS (SELECT label, vec_id, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label, vec_id, round(CASE WHEN b IS NOT NULL THEN list_sum([abs(CAST(a[i] AS DOUBLE) - CAST(b[i] AS DOUBLE)) FOR i IN range(1, 65)]) / 64 END, 6) AS change FROM n""")  # fmt: skip
def frame_change(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("px"))
    return r6(ordered.difference_from_previous(e, ["label"], "vec_id", "px").select("label", "vec_id", "change"), "change")


# ---- joins by nearness


def first_type(e: DataFrame) -> str:
    return e.agg(F.min("event_type")).first()[0]


def split_by_type(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of the first type, and all others."""
    first = first_type(e)
    return e.where(F.col("event_type") == first), e.where(F.col("event_type") != first)


def click_pairs(spark, d):
    return split_by_type(events(spark, d))


FIRST = "(SELECT min(event_type) FROM events)"
PAIRS = f"WITH a AS (SELECT user_id, event_id, value FROM events WHERE event_type = {FIRST}), b AS (SELECT user_id, event_id, value FROM events WHERE event_type <> {FIRST})"


@query("asof_backward", PAIRS + """
SELECT a.user_id, a.event_id, b.value AS last_value, b.event_id AS event_id_right FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.event_id >= b.event_id""")  # fmt: skip
def asof_backward(spark, d):
    a, b = click_pairs(spark, d)
    return matching.asof(a.select("user_id", "event_id"), b.select("user_id", "event_id", F.col("value").alias("last_value")), ["user_id"], "event_id", ["last_value"])


@query("asof_forward_tolerance", PAIRS + """
SELECT a.user_id, a.event_id, CASE WHEN b.event_id - a.event_id <= 100 THEN b.value END AS next_value, CASE WHEN b.event_id - a.event_id <= 100 THEN b.event_id END AS event_id_right FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.event_id <= b.event_id""")  # fmt: skip
def asof_forward_tolerance(spark, d):
    a, b = click_pairs(spark, d)
    return matching.asof(a.select("user_id", "event_id"), b.select("user_id", "event_id", F.col("value").alias("next_value")), ["user_id"], "event_id", ["next_value"], forward=True, tolerance=100)


@query("nearest_within", PAIRS + """
, p AS (SELECT a.user_id, a.event_id, b.event_id AS bid, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.event_id - b.event_id), b.event_id) AS k FROM a LEFT JOIN b ON a.user_id = b.user_id)
SELECT user_id, event_id, CASE WHEN abs(event_id - bid) <= 80 THEN value END AS near_value, CASE WHEN abs(event_id - bid) <= 80 THEN bid END AS event_id_right FROM p WHERE k = 1""")  # fmt: skip
def nearest_within(spark, d):
    a, b = click_pairs(spark, d)
    return matching.nearest(a.select("user_id", "event_id"), b.select("user_id", "event_id", F.col("value").alias("near_value")), ["user_id"], "event_id", ["near_value"], 80)


@query("banded_pairs", PAIRS + """
SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM a JOIN b ON a.user_id = b.user_id AND abs(a.value - b.value) <= 5.0""")  # fmt: skip
def banded_pairs(spark, d):
    a, b = click_pairs(spark, d)
    p = matching.banded(a.select("user_id", F.col("event_id").alias("a_id"), F.col("value").alias("va")), b.select("user_id", F.col("event_id").alias("b_id"), F.col("value").alias("vb")), ["user_id"], "va", "vb", 5.0)
    return p.select("user_id", "a_id", "b_id")


@query("mutual_nearest", PAIRS + """
, p AS (SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id, abs(a.value - b.value) AS gap FROM a JOIN b ON a.user_id = b.user_id AND abs(a.value - b.value) <= 5.0),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id, a_id ORDER BY gap, b_id) AS x, row_number() OVER (PARTITION BY user_id, b_id ORDER BY gap, a_id) AS y FROM p)
SELECT user_id, a_id, b_id, round(gap, 6) AS gap FROM q WHERE x = 1 AND y = 1""")  # fmt: skip
def mutual_nearest(spark, d):
    a, b = click_pairs(spark, d)
    p = matching.mutual_nearest(a.select("user_id", F.col("event_id").alias("a_id"), F.col("value").alias("va")), b.select("user_id", F.col("event_id").alias("b_id"), F.col("value").alias("vb")), ["user_id"], "a_id", "b_id", "va", "vb", 5.0)
    return r6(p.select("user_id", "a_id", "b_id", "gap"), "gap")


@query("interval_join", """
WITH c AS (SELECT p_partkey, p_retailprice AS lo, p_retailprice + 3.0 AS hi FROM part)
SELECT o.event_id, c.p_partkey FROM events o JOIN c ON o.value * 4 >= c.lo AND o.value * 4 < c.hi""")  # fmt: skip
def interval_join(spark, d):
    spans = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 3.0).alias("hi"))
    return matching.interval(events(spark, d).select("event_id", (F.col("value") * 4).alias("at")), spans, [], "at", "lo", "hi", 3.0).select("event_id", "p_partkey")


@query("linear_map", """
WITH n AS (SELECT (SELECT count(*) FROM supplier) AS a, (SELECT count(*) FROM customer) AS b)
SELECT s_suppkey AS i, CAST(round_even(s_suppkey * (b - 1.0e0) / (a - 1), 0) AS INT) AS j FROM supplier CROSS JOIN n""")  # fmt: skip
def linear_map(spark, d):
    """Suppliers spread evenly over customers."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    return s.select(F.col("s_suppkey").alias("i"), matching.linear_map(s.count(), c.count())(F.col("s_suppkey")).alias("j"))


@query("collapse_map", """
WITH n AS (SELECT DISTINCT l_suppkey AS i FROM lineitem), m AS (SELECT l_suppkey AS i, CAST(floor(median(l_linenumber)) AS INT) AS j FROM lineitem GROUP BY 1)
SELECT n.i, coalesce(j, -1) AS j FROM n LEFT JOIN m ON m.i = n.i""")  # fmt: skip
def collapse_map(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j"))
    return matching.collapse_map(li, li.select("i").distinct(), [], "i", "j")


@query("alignment_offset", f"""
WITH e AS ({INDEXED}), a AS (SELECT user_id, i, event_id FROM e WHERE event_type = {FIRST}), b AS (SELECT user_id, i + 7 AS ri, event_id FROM e WHERE event_type <> {FIRST}),
p AS (SELECT a.user_id, a.i, b.ri, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.event_id - b.event_id), b.event_id) AS k, abs(a.event_id - b.event_id) AS g FROM a JOIN b ON a.user_id = b.user_id)
SELECT user_id, count(*) AS n, CASE WHEN count(*) < 10 THEN 0.0 ELSE median(ri - i) END AS "offset" FROM p WHERE k = 1 AND g <= 140 GROUP BY user_id""")  # fmt: skip
def alignment_offset(spark, d):
    one, others = split_by_type(indexed(spark, d).select("user_id", "i", "event_id", "event_type"))
    return matching.alignment_offset(one, others.withColumn("i", F.col("i") + 7), ["user_id"], "i", "event_id", 140)


# ---- interpolation


@query("interpolate_hold", f"""
WITH k AS (SELECT user_id, event_id AS t, value AS v FROM events WHERE event_type <> {FIRST}), q AS (SELECT user_id, event_id AS t FROM events),
a AS (SELECT q.*, k.t AS t0, k.v AS v0 FROM q ASOF LEFT JOIN k ON q.user_id = k.user_id AND q.t >= k.t),
b AS (SELECT a.*, k.t AS t1, k.v AS v1 FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.t <= k.t)
SELECT user_id, t, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END + 1e-7, 4) AS v FROM b""")  # fmt: skip
def interpolate_hold(spark, d):
    e = events(spark, d).select("user_id", F.col("event_id").alias("t"), F.col("value").alias("v"), "event_type")
    knots = split_by_type(e)[1].select("user_id", "t", "v")
    return interp.interpolate(e.select("user_id", "t"), knots, ["user_id"], "t", "v").withColumn("v", F.round(F.col("v") + 1e-7, 4))  # off the ties of rounding


@query("extend_line", f"""
WITH e AS ({INDEXED}), k AS (SELECT user_id, CAST(i AS DOUBLE) AS t, value AS v FROM e WHERE event_type <> {FIRST}), q AS (SELECT user_id, CAST(i AS DOUBLE) AS t FROM e),
x AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM k GROUP BY user_id),
l AS (SELECT k.user_id, regr_slope(v, t) AS a, regr_intercept(v, t) AS b, count(*) AS n FROM k JOIN x ON x.user_id = k.user_id WHERE t <= lo + 8 GROUP BY 1),
h AS (SELECT k.user_id, regr_slope(v, t) AS a, regr_intercept(v, t) AS b, count(*) AS n FROM k JOIN x ON x.user_id = k.user_id WHERE t >= hi - 8 GROUP BY 1),
a AS (SELECT q.*, k.t AS t0, k.v AS v0 FROM q ASOF LEFT JOIN k ON q.user_id = k.user_id AND q.t >= k.t),
b AS (SELECT a.*, k.t AS t1, k.v AS v1 FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.t <= k.t)
SELECT b.user_id, b.t, round(CASE WHEN t < lo AND l.n >= 3 THEN l.a * t + l.b WHEN t > hi AND h.n >= 3 THEN h.a * t + h.b WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END + 1e-7, 4) AS v,
  CASE WHEN (t < lo AND l.n >= 3) OR (t > hi AND h.n >= 3) THEN 'line' WHEN t < lo OR t > hi THEN 'hold' ELSE 'inside' END AS origin
FROM b LEFT JOIN x ON x.user_id = b.user_id LEFT JOIN l ON l.user_id = b.user_id LEFT JOIN h ON h.user_id = b.user_id""")  # fmt: skip
def extend_line(spark, d):
    e = indexed(spark, d).select("user_id", F.col("i").cast("double").alias("t"), F.col("value").alias("v"), "event_type")
    out = interp.extend_line(e.select("user_id", "t"), split_by_type(e)[1].select("user_id", "t", "v"), ["user_id"], "t", "v", 8.0)
    return out.select("user_id", "t", F.round(F.col("v") + 1e-7, 4).alias("v"), "origin")


@query("resample_index", f"""
WITH c AS ({CELLS}), q AS (SELECT z, j, j * 63.0 / 99.0 AS p FROM (SELECT DISTINCT z FROM c) CROSS JOIN (SELECT unnest(range(100)) AS j)),
a AS (SELECT q.z, q.j, q.p, c.v AS v0, c.col AS i FROM q JOIN c ON c.z = q.z AND c.col = least(floor(q.p), 62))
SELECT a.z, CAST(a.j AS INT) AS col, round(a.v0 + (c.v - a.v0) * (a.p - a.i), 6) AS v FROM a JOIN c ON c.z = a.z AND c.col = a.i + 1""")  # fmt: skip
def resample_index(spark, d):
    return r6(interp.resample_index(cells(spark, d), ["z"], "col", "v", 100), "v")


@query("resample_nearest", f"""
WITH c AS ({CELLS}) SELECT q.z, CAST(q.j AS INT) AS at, q.col, c.v FROM (SELECT z, j, CAST(round_even(j * 63.0 / 20.0, 0) AS BIGINT) AS col FROM (SELECT DISTINCT z FROM c) CROSS JOIN (SELECT unnest(range(21)) AS j)) q JOIN c ON c.z = q.z AND c.col = q.col""")  # fmt: skip
def resample_nearest(spark, d):
    c = cells(spark, d).select("z", F.col("col").alias("src"), "v")
    return interp.resample_nearest(c, ["z"], "src", 21).select("z", F.col("col").alias("at"), F.col("src").alias("col"), "v")


@query("arc_columns", f"""
WITH e AS ({INDEXED}), s AS (SELECT user_id, CAST(i AS DOUBLE) AS phi, coalesce(sqrt(1 + power(value - lag(value) OVER w, 2)), 0.0) AS st FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)),
k AS (SELECT user_id, phi, sum(st) OVER (PARTITION BY user_id ORDER BY phi) AS s FROM s),
n AS (SELECT user_id, max(s) AS len, greatest(CAST(round_even(max(s) / 500.0, 0) AS INT), 1) AS n FROM k GROUP BY user_id),
q AS (SELECT user_id, c AS col, c * (len / n) AS t FROM (SELECT *, unnest(range(n + 1)) AS c FROM n)),
a AS (SELECT q.*, k.s AS t0, k.phi AS v0 FROM q ASOF LEFT JOIN k ON q.user_id = k.user_id AND q.t >= k.s),
b AS (SELECT a.*, k.s AS t1, k.phi AS v1 FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.t <= k.s)
SELECT user_id, CAST(col AS INT) AS col, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 4) AS phi FROM b""")  # fmt: skip
def arc_columns(spark, d):
    p = indexed(spark, d).select("user_id", F.col("i").cast("double").alias("phi"), "value")
    s = ordered.arc_length(p, ["user_id"], "phi", "phi", "value")
    return interp.arc_columns(s, ["user_id"], "s", "phi", 500.0).select("user_id", "col", F.round("phi", 4).alias("phi"))


@query("histogram_match", f"""
WITH s AS (SELECT user_id AS k, value AS v FROM events WHERE event_type = {FIRST}), r AS (SELECT user_id AS k, value AS v FROM events WHERE event_type <> {FIRST}),
cs AS (SELECT k, v, sum(count(*)) OVER (PARTITION BY k ORDER BY v) / CAST(sum(count(*)) OVER (PARTITION BY k) AS DOUBLE) AS q FROM s GROUP BY k, v),
cr AS (SELECT k, v, sum(count(*)) OVER (PARTITION BY k ORDER BY v) / CAST(sum(count(*)) OVER (PARTITION BY k) AS DOUBLE) AS q FROM r GROUP BY k, v),
a AS (SELECT cs.*, cr.q AS t0, cr.v AS v0 FROM cs ASOF LEFT JOIN cr ON cs.k = cr.k AND cs.q >= cr.q),
b AS (SELECT a.*, cr.q AS t1, cr.v AS v1 FROM a ASOF LEFT JOIN cr ON a.k = cr.k AND a.q <= cr.q),
m AS (SELECT k, v, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (q - t0) / (t1 - t0) END AS matched FROM b)
SELECT s.k AS user_id, s.v AS value, round(m.matched + 1e-7, 5) AS matched FROM s JOIN m ON m.k = s.k AND m.v = s.v""")  # fmt: skip
def histogram_match(spark, d):
    one, others = split_by_type(events(spark, d).select("event_type", "user_id", "value"))
    out = interp.histogram_match(one.select("user_id", "value"), others.select("user_id", "value"), ["user_id"], "value")
    return out.select("user_id", "value", F.round(F.col("matched") + 1e-7, 5).alias("matched"))


@query("z_fill", f"""
WITH e AS ({INDEXED}), x AS (SELECT user_id, i, CASE WHEN event_type = {FIRST} THEN value END AS v FROM e),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS bi, last_value(v IGNORE NULLS) OVER a AS bv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ai, first_value(v IGNORE NULLS) OVER b AS av FROM x
  WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, i, CASE WHEN coalesce(i - bi <= ai - i, bi IS NOT NULL) THEN bv ELSE av END AS filled, CASE WHEN v IS NOT NULL THEN 'walked' ELSE 'copied' END AS origin FROM k""")  # fmt: skip
def z_fill(spark, d):
    e = indexed(spark, d)
    first = first_type(e)
    return interp.z_fill(e, ["user_id"], "i", F.when(F.col("event_type") == first, F.col("value")), "filled").select("user_id", "i", "filled", "origin")


@query("blend", f"""
WITH c AS ({CELLS}) SELECT a.z, a.col, round(a.v * 0.75 + b.v * 0.25, 6) AS v, 'blended' AS origin FROM c a JOIN c b ON b.z = a.z + 1 AND b.col = a.col""")  # fmt: skip
def blend(spark, d):
    c = cells(spark, d).select("z", "col", "v")
    return r6(interp.blend(c, c.withColumn("z", F.col("z") - 1), ["z", "col"], "v", 0.25), "v")


@query("bilinear", f"""
WITH c AS ({CELLS}), p AS (SELECT vec_id, 0.37 * (vec_id % 100) AS x, 0.53 * (vec_id % 90) AS y FROM embeddings),
w AS (SELECT p.*, floor(y) + i AS r, floor(x) + j AS q, (1 - abs(x - floor(x) - j)) * (1 - abs(y - floor(y) - i)) AS wt FROM p CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j))
SELECT w.vec_id, round(sum(coalesce(c.v, 0) * wt), 6) AS v FROM w LEFT JOIN c ON c.z = w.r AND c.col = w.q GROUP BY w.vec_id""")  # fmt: skip
def bilinear(spark, d):
    px = cells(spark, d).select(F.col("z").cast("int").alias("row"), "col", "v")
    p = table(spark, d, "embeddings").select("vec_id", (0.37 * (F.col("vec_id") % 100)).alias("x"), (0.53 * (F.col("vec_id") % 90)).alias("y"))
    return r6(interp.bilinear(p, px, [], "x", "y", "v").select("vec_id", "v"), "v")


# ---- aggregations


@query("scatter_mean", """
SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS "row", CAST(floor(l_discount * 100 / 2 + 1e-9) AS BIGINT) AS col, round(avg(l_extendedprice), 4) AS mean, count(*) AS n FROM lineitem GROUP BY ALL""")  # fmt: skip
def scatter_mean(spark, d):
    li = table(spark, d, "lineitem")
    return agg.scatter_mean(li, F.floor(F.col("l_quantity") / 5), F.floor(F.col("l_discount") * 100 / 2 + 1e-9), F.col("l_extendedprice")).withColumn("mean", F.round("mean", 4))


@query("scatter_label", """
SELECT CAST(l_suppkey % 10 AS BIGINT) AS "row", CAST(l_partkey % 10 AS BIGINT) AS col, round(avg(l_quantity), 6) AS mean, CAST(round_even(avg(l_linenumber), 0) AS INT) AS label FROM lineitem GROUP BY ALL""")  # fmt: skip
def scatter_label(spark, d):
    li = table(spark, d, "lineitem")
    return r6(agg.scatter_label(li, F.col("l_suppkey") % 10, F.col("l_partkey") % 10, F.col("l_quantity"), F.col("l_linenumber")), "mean")


@query("scatter_dense", """
WITH g AS (SELECT i // 8 AS "row", i % 8 AS col FROM (SELECT unnest(range(64)) AS i)), c AS (SELECT CAST(floor(l_quantity / 7) AS BIGINT) AS "row", CAST(l_linenumber AS BIGINT) AS col, avg(l_tax) AS mean FROM lineitem GROUP BY ALL)
SELECT g."row", g.col, round(coalesce(mean, 0), 6) AS mean FROM g LEFT JOIN c ON c."row" = g."row" AND c.col = g.col""")  # fmt: skip
def scatter_dense(spark, d):
    c = agg.scatter_mean(table(spark, d, "lineitem"), F.floor(F.col("l_quantity") / 7), F.col("l_linenumber").cast("long"), F.col("l_tax"))
    return r6(agg.densify(c, 8, 8, "mean").select("row", "col", "mean"), "mean")


@query("centroid", "SELECT event_type, round(avg(value), 6) AS cx, round(avg(user_id), 6) AS cy, count(*) AS n FROM events GROUP BY event_type")
def centroid(spark, d):
    return r6(agg.centroid(events(spark, d), ["event_type"], "value", "user_id"), "cx", "cy")


@query("circular_mean", """
WITH a AS (SELECT user_id, value / 80.0 AS t FROM events), m AS (SELECT user_id, atan2(avg(sin(t)), avg(cos(t))) AS rough FROM a GROUP BY user_id),
n AS (SELECT a.user_id, t, rough, (t - rough + pi()) - 2 * pi() * floor((t - rough + pi()) / (2 * pi())) - pi() AS w FROM a JOIN m ON m.user_id = a.user_id)
SELECT user_id, round(any_value(rough), 6) AS rough, round(atan2(avg(sin(t)), avg(cos(t))), 6) AS mean, count(*) AS n FROM n WHERE abs(w) <= radians(60) GROUP BY user_id""")  # fmt: skip
def circular_mean(spark, d):
    return r6(agg.trimmed_circular_mean(events(spark, d).withColumn("t", F.col("value") / 80.0), ["user_id"], "t", 60.0), "rough", "mean")


@query("otsu", f"""
WITH c AS ({CELLS}), s AS (SELECT label, min(v) AS lo, (max(v) - min(v)) / 64 AS w FROM c GROUP BY label),
h AS (SELECT c.label, CAST(least(floor((v - lo) / w), 63) AS INT) AS bin, any_value(lo) AS lo, any_value(w) AS w, CAST(count(*) AS DOUBLE) AS n FROM c JOIN s ON s.label = c.label GROUP BY 1, 2),
m AS (SELECT *, lo + (bin + 0.5) * w AS x FROM h),
a AS (SELECT *, sum(n) OVER o AS w0, sum(n * x) OVER o AS s0, sum(n) OVER t AS wt, sum(n * x) OVER t AS st FROM m WINDOW o AS (PARTITION BY label ORDER BY bin), t AS (PARTITION BY label)),
b AS (SELECT *, coalesce(w0 * (wt - w0) * power(s0 / w0 - (st - s0) / nullif(wt - w0, 0), 2), -1.0) AS between_ FROM a)
SELECT label, bin, round(x, 6) AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY label ORDER BY between_ DESC, bin) = 1""")  # fmt: skip
def otsu(spark, d):
    return r6(agg.otsu(cells(spark, d), ["label"], "v", 64), "threshold")


@query("mutual_information", f"""
WITH c AS ({CELLS}), p AS (SELECT a.label, a.v AS a, b.v AS b FROM c a JOIN c b ON b.z = a.z + 1 AND b.col = a.col AND a.v BETWEEN -4 AND 4 AND b.v BETWEEN -4 AND 4),
x AS (SELECT label, least(floor((a + 4) / 0.5), 15) AS i, least(floor((b + 4) / 0.5), 15) AS j FROM p),
t AS (SELECT label, count(*) AS t FROM x GROUP BY label),
ha AS (SELECT label, -sum(n / t * ln(n / t)) AS h FROM (SELECT label, i, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY ALL) JOIN t USING (label) GROUP BY label),
hb AS (SELECT label, -sum(n / t * ln(n / t)) AS h FROM (SELECT label, j, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY ALL) JOIN t USING (label) GROUP BY label),
hab AS (SELECT label, -sum(n / t * ln(n / t)) AS h FROM (SELECT label, i, j, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY ALL) JOIN t USING (label) GROUP BY label)
SELECT label, round((ha.h + hb.h) / hab.h, 6) AS nmi FROM ha JOIN hb USING (label) JOIN hab USING (label)""")  # fmt: skip
def mutual_information(spark, d):
    c = cells(spark, d).select("label", "z", "col", F.col("v").alias("a"))
    nxt = c.select((F.col("z") - 1).alias("z"), "col", F.col("a").alias("b"))
    return r6(agg.mutual_information(c.join(nxt, ["z", "col"]), ["label"], "a", "b", 16, (-4.0, 4.0)), "nmi")


PAIR_ROWS = f"WITH c AS ({CELLS}), p AS (SELECT a.z, a.label, a.v AS a, b.v AS b FROM c a JOIN c b ON b.z = a.z + 1 AND b.col = a.col)"


def row_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return c.select("z", "label", "col", F.col("v").alias("a")).join(c.select((F.col("z") - 1).alias("z"), "col", F.col("v").alias("b")), ["z", "col"])


@query("pair_errors", PAIR_ROWS + """
SELECT z, round(avg(power(a - b, 2)), 6) AS mse, round(sqrt(avg(power(a - b, 2))), 6) AS rmse, round(avg(abs(a - b)), 6) AS mae, round(10 * log10(1 / avg(power(a - b, 2))), 6) AS psnr FROM p GROUP BY z""")  # fmt: skip
def pair_errors(spark, d):
    return r6(agg.pair_errors(row_pairs(spark, d), ["z"], "a", "b"), "mse", "rmse", "mae", "psnr")


@query("psnr_two_ways", PAIR_ROWS + """
, e AS (SELECT z, any_value(label) AS label, avg(power(a - b, 2)) AS mse FROM p GROUP BY z) SELECT label, round(avg(10 * log10(1 / mse)), 6) AS mean_psnr, round(10 * log10(1 / avg(mse)), 6) AS psnr_of_mean FROM e GROUP BY label""")  # fmt: skip
def psnr_two_ways(spark, d):
    return r6(agg.psnr_two_ways(agg.pair_errors(row_pairs(spark, d), ["label", "z"], "a", "b"), ["label"]), "mean_psnr", "psnr_of_mean")


@query("weighted_correlation", PAIR_ROWS + """
, s AS (SELECT label, sum(w) AS w, sum(w * a) / sum(w) AS x, sum(w * b) / sum(w) AS y, sum(w * a * a) / sum(w) AS xx, sum(w * b * b) / sum(w) AS yy, sum(w * a * b) / sum(w) AS xy FROM (SELECT *, abs(a) AS w FROM p) GROUP BY label)
SELECT label, round((xy - x * y) / sqrt((xx - x * x) * (yy - y * y)), 6) AS corr FROM s""")  # fmt: skip
def weighted_correlation(spark, d):
    return r6(agg.weighted_correlation(row_pairs(spark, d).withColumn("w", F.abs("a")), ["label"], "a", "b", "w"), "corr")


@query("row_coherence", PAIR_ROWS + " SELECT z, round(corr(a, b), 6) AS corr FROM p GROUP BY z")
def row_coherence(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("z"), "embedding")
    return r6(agg.row_coherence(e, "z", "embedding"), "corr")


@query("strip_scores", PAIR_ROWS + """
SELECT round((SELECT quantile_cont(v, 0.95) - quantile_cont(v, 0.05) FROM c), 6) AS dynamic_range, round((SELECT avg(CAST(v <> 0 AS INT)) FROM c), 6) AS filled, round((SELECT avg(x) FROM (SELECT var_pop(v) AS x FROM c GROUP BY z)), 6) AS row_var_mean, round((SELECT avg(r) FROM (SELECT corr(a, b) AS r FROM p GROUP BY z)), 6) AS z_coherence""")  # fmt: skip
def strip_scores(spark, d):
    return r6(agg.strip_scores(table(spark, d, "embeddings"), "vec_id", "embedding"), "dynamic_range", "filled", "row_var_mean", "z_coherence")


@query("robust_scatter", """
WITH m AS (SELECT user_id, median(value) AS m, count(*) AS n FROM events GROUP BY user_id)
SELECT e.user_id, round(CASE WHEN any_value(n) >= 3 THEN 1.4826 * median(abs(value - m)) END, 6) AS scatter, any_value(n) AS n FROM events e JOIN m ON m.user_id = e.user_id GROUP BY e.user_id""")  # fmt: skip
def robust_scatter(spark, d):
    return r6(agg.robust_scatter(events(spark, d), ["user_id"], "value"), "scatter")


@query("line_fit", "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def line_fit(spark, d):
    f = agg.line_fit(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return f.withColumns({"slope": F.round("slope", 5), "intercept": F.round("intercept", 4)})


def _clip_sql(rounds: int, limit: float) -> str:
    parts = [f"r0 AS (SELECT user_id, i, value AS y, true AS used FROM ({INDEXED}))"]
    for k in range(rounds + 1):
        parts.append(f"f{k} AS (SELECT user_id, regr_slope(y, i) AS a, regr_intercept(y, i) AS b FROM r{k} WHERE used GROUP BY user_id), g{k} AS (SELECT r.*, a * i + b AS fit, y - (a * i + b) AS res FROM r{k} r JOIN f{k} f ON f.user_id = r.user_id)")
        if k < rounds:
            parts.append(f"s{k} AS (SELECT user_id, 1.4826 * median(abs(res)) AS s FROM g{k} WHERE used GROUP BY user_id), r{k + 1} AS (SELECT g.user_id, i, y, abs(res) <= {limit} * s AS used FROM g{k} g JOIN s{k} s ON s.user_id = g.user_id)")
    return "WITH " + ", ".join(parts) + f" SELECT user_id, i, used, round(fit, 5) AS fit FROM g{rounds}"


@query("clipped_line", _clip_sql(2, 2.5))
def clipped_line(spark, d):
    c = agg.clipped_line(indexed(spark, d).select("user_id", "i", F.col("value").alias("y")), ["user_id"], "i", "y", 2)
    return c.select("user_id", "i", "used", F.round("fit", 5).alias("fit"))


@query("circle_fit", """
WITH m AS (SELECT event_type, avg(value) AS mx, avg(user_id) AS my FROM events GROUP BY 1), d AS (SELECT e.event_type, mx, my, value - mx AS u, user_id - my AS v FROM events e JOIN m ON m.event_type = e.event_type),
s AS (SELECT event_type, any_value(mx) AS mx, any_value(my) AS my, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * (u * u + v * v)) AS uz, sum(v * (u * u + v * v)) AS vz, avg(u * u + v * v) AS z FROM d GROUP BY 1),
k AS (SELECT *, (uz * vv - vz * uv) / (2 * (uu * vv - uv * uv)) AS a, (vz * uu - uz * uv) / (2 * (uu * vv - uv * uv)) AS b FROM s)
SELECT event_type, round(mx + a, 5) AS cx, round(my + b, 5) AS cy, round(sqrt(a * a + b * b + z), 5) AS r FROM k""")  # fmt: skip
def circle_fit(spark, d):
    c = agg.circle_fit(events(spark, d), ["event_type"], "value", "user_id")
    return c.withColumns({x: F.round(x, 5) for x in ("cx", "cy", "r")})


@query("phase_fold", """
WITH f AS (SELECT event_type, CAST(floor((event_id % 37) / 37.0 * 12) AS INT) AS phase, avg(value) AS m FROM events GROUP BY ALL)
SELECT event_type, phase, round(m, 6) AS mean, row_number() OVER (PARTITION BY event_type ORDER BY m, phase) AS rank FROM f""")  # fmt: skip
def phase_fold(spark, d):
    return r6(agg.phase_fold(events(spark, d), ["event_type"], "event_id", "value", 37, 12), "mean")


@query("best_phase", """
SELECT event_type, "offset", round(m, 6) AS mean FROM (SELECT event_type, event_id % 16 AS "offset", avg(value) AS m FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY m DESC, "offset") = 1""")  # fmt: skip
def best_phase(spark, d):
    return r6(agg.best_phase(events(spark, d), ["event_type"], "event_id", "value", 16), "mean")


@query("block_ratio", f"""
WITH b AS (SELECT z // 20 AS br, col // 8 AS bc, avg(abs(v)) AS m FROM ({CELLS}) GROUP BY ALL)
SELECT br, bc, round(m, 6) AS mean, round(m / quantile_cont(m, 0.5) OVER (PARTITION BY bc ORDER BY br ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS ratio FROM b""")  # fmt: skip
def block_ratio(spark, d):
    return r6(agg.block_ratio(cells(spark, d).withColumn("v", F.abs("v")), "z", "col", "v", 20, 8), "mean", "ratio")


@query("metric_summary", PAIR_ROWS + """
, e AS (SELECT z, any_value(label) AS label, avg(abs(a - b)) AS mae, corr(a, b) AS corr FROM p GROUP BY z), u AS (SELECT label, 'mae' AS metric, mae AS v FROM e UNION ALL SELECT label, 'corr', corr FROM e)
SELECT label, metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, count(v) AS n FROM u GROUP BY label, metric""")  # fmt: skip
def metric_summary(spark, d):
    e = row_pairs(spark, d).groupBy("label", "z").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.corr("a", "b").alias("corr"))
    return r6(agg.metric_summary(e, ["label"], ["mae", "corr"]), "mean", "median")


@query("nonfinite_as_zero", "SELECT l_returnflag, round(avg(coalesce(l_extendedprice / nullif(l_linenumber - 1, 0), 0)), 4) AS x FROM lineitem GROUP BY 1")
def nonfinite_as_zero(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", sem.ratio(F.col("l_extendedprice"), F.col("l_linenumber") - 1).alias("x"))
    return agg.mean_nonfinite_as_zero(li, ["l_returnflag"], ["x"]).withColumn("x", F.round("x", 4))


@query("polynomial_fit", """
WITH m AS (SELECT event_type, avg(event_id) AS x0 FROM events GROUP BY 1), d AS (SELECT e.event_type, x0, (event_id - x0) AS x, value AS y FROM events e JOIN m ON m.event_type = e.event_type),
s AS (SELECT event_type, any_value(x0) AS x0, CAST(count(*) AS DOUBLE) AS n, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2 FROM d GROUP BY 1),
k AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM s)
SELECT event_type, round(x0, 4) AS x0, round((t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / det, 4) AS c0 FROM k""")  # fmt: skip
def polynomial_fit(spark, d):
    p = agg.polynomial_fit(events(spark, d), ["event_type"], "event_id", "value")
    return p.select("event_type", F.round("x0", 4).alias("x0"), F.round("c0", 4).alias("c0"))


# ---- expressions


@query("percentile_stretch", f"""
WITH c AS ({CELLS}), p AS (SELECT z, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM c GROUP BY z)
SELECT c.z, col, round(CASE WHEN hi - lo < 1e-8 THEN 0.0 ELSE least(greatest((v - lo) / (hi - lo + 1e-6), 0.0), 1.0) END, 6) AS v FROM c JOIN p ON p.z = c.z""")  # fmt: skip
def percentile_stretch(spark, d):
    c = cells(spark, d)
    p = c.groupBy("z").agg(F.percentile("v", F.lit(0.01)).alias("lo"), F.percentile("v", F.lit(0.99)).alias("hi"))
    return r6(c.join(p, "z").select("z", "col", sem.stretch(F.col("v"), F.col("lo"), F.col("hi")).alias("v")), "v")


@query("levels_airness", f"""
WITH c AS ({CELLS}), l AS (SELECT quantile_cont(v, 0.01) AS air, quantile_cont(v, 0.75) AS film FROM c)
SELECT z, col, round(least(greatest((film - v) / (film - air), 0.0), 1.3), 6) AS airness FROM c CROSS JOIN l""")  # fmt: skip
def levels_airness(spark, d):
    c = cells(spark, d)
    lv = c.agg(F.percentile("v", F.lit(0.01)).alias("air"), F.percentile("v", F.lit(0.75)).alias("film"))
    return r6(c.join(F.broadcast(lv)).select("z", "col", sem.airness(F.col("v"), F.col("air"), F.col("film")).alias("airness")), "airness")  # one row


@query("class_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS cls FROM embeddings")
def class_argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", sem.first_argmax(F.col("embedding")).alias("cls"))


@query("polar", """
SELECT event_id, round(sqrt(power(value - 245, 2) + power(user_id - 75, 2)), 6) AS r, round(CASE WHEN atan2(user_id - 75, value - 245) < 0 THEN atan2(user_id - 75, value - 245) + 2 * pi() ELSE atan2(user_id - 75, value - 245) END, 6) AS theta FROM events""")  # fmt: skip
def polar(spark, d):
    r, t = sem.polar(F.col("value"), F.col("user_id"), F.lit(245.0), F.lit(75.0))
    return r6(events(spark, d).select("event_id", r.alias("r"), t.alias("theta")), "r", "theta")


@query("histogram_bins", "SELECT event_id, CAST(CASE WHEN value BETWEEN 0 AND 490.02 THEN least(floor(value / (490.02 / 64)), 63) END AS INT) AS bin FROM events")
def histogram_bins(spark, d):
    return events(spark, d).select("event_id", sem.histogram_bin(F.col("value"), 0.0, 490.02, 64).alias("bin"))


@query("one_hot_luma", """
SELECT vec_id, array_to_string([CAST(label = i AS INT) FOR i IN range(10)], ',') AS hot, round(0.299 * CAST(embedding[1] AS DOUBLE) + 0.587 * CAST(embedding[2] AS DOUBLE) + 0.114 * CAST(embedding[3] AS DOUBLE), 6) AS luma, CAST(floor(least(greatest(CAST(embedding[1] AS DOUBLE), 0), 1) * 255) AS INT) AS u8 FROM embeddings""")  # fmt: skip
def one_hot_luma(spark, d):
    e = [F.col("embedding")[k].cast("double") for k in range(3)]
    return r6(table(spark, d, "embeddings").select("vec_id", F.array_join(sem.one_hot(F.col("label"), 10).cast("array<string>"), ",").alias("hot"), sem.luma(*e).alias("luma"), sem.to_u8(e[0]).alias("u8")), "luma")


@query("parabola_peaks", f"""
WITH c AS ({CELLS}), n AS (SELECT z, col, v, lag(v) OVER w AS l, lead(v) OVER w AS r FROM c WINDOW w AS (PARTITION BY z ORDER BY col)), t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY z ORDER BY v DESC, col) = 1)
SELECT z, round(col + coalesce(CASE WHEN l - 2 * v + r = 0 THEN 0 ELSE least(greatest(0.5 * (l - r) / (l - 2 * v + r), -1), 1) END, 0), 6) AS peak FROM t""")  # fmt: skip
def parabola_peaks(spark, d):
    w = sem.ordered(["z"], "col")
    c = cells(spark, d).withColumns({"l": F.lag("v").over(w), "r": F.lead("v").over(w), "k": F.row_number().over(sem.ordered(["z"], F.desc("v"), "col"))}).where("k = 1")
    return r6(c.select("z", (F.col("col") + F.coalesce(sem.parabola_peak(F.col("l"), F.col("v"), F.col("r")), F.lit(0.0))).alias("peak")), "peak")


@query("spiral_position", "SELECT vec_id, round((sqrt(20.0 * 20.0 + 2 * 1.5 * (vec_id / 3000.0) * 5000.0) - 20.0) / 1.5, 6) AS theta FROM embeddings")
def spiral_position(spark, d):
    return r6(table(spark, d, "embeddings").select("vec_id", sem.spiral_angle(F.col("vec_id") / 3000.0, 20.0, 1.5, 5000.0).alias("theta")), "theta")


@query("top_blocks", "SELECT z, col, round(v, 6) AS v FROM (" + CELLS + ") ORDER BY abs(v) DESC, z, col LIMIT 50")
def top_blocks(spark, d):
    return r6(cells(spark, d).orderBy(F.desc(F.abs("v")), "z", "col").limit(50).select("z", "col", "v"), "v")


@query("attachment_and_conformal", f"""
WITH c AS ({CELLS}), n AS (SELECT z, v, lead(v) OVER (PARTITION BY z ORDER BY col) - v AS gx, v - lag(v) OVER (PARTITION BY z ORDER BY col) AS gy FROM c)
SELECT z, round(avg(power(1 - v, 2)), 6) AS attachment, round(avg(power(gx * gx - gy * gy, 2) + 4 * power(gx * gy, 2)), 4) AS conformal FROM n GROUP BY z""")  # fmt: skip
def attachment_and_conformal(spark, d):
    w = sem.ordered(["z"], "col")
    n = cells(spark, d).withColumns({"gx": F.lead("v").over(w) - F.col("v"), "gy": F.col("v") - F.lag("v").over(w)})
    gx, gy = F.col("gx"), F.col("gy")
    return n.groupBy("z").agg(F.round(F.avg(F.pow(1 - F.col("v"), 2)), 6).alias("attachment"), F.round(F.avg(F.pow(gx * gx - gy * gy, 2) + 4 * F.pow(gx * gy, 2)), 4).alias("conformal"))


@query("overlap_shift", f"""
WITH c AS ({CELLS}) SELECT a.z, a.col, round(a.v - b.v, 6) AS d FROM c a JOIN c b ON b.z = a.z - 2 AND b.col = a.col - 3""")  # fmt: skip
def overlap_shift(spark, d):
    c = cells(spark, d)
    moved = c.select((F.col("z") + 2).alias("z"), (F.col("col") + 3).alias("col"), F.col("v").alias("b"))
    return r6(c.join(moved, ["z", "col"]).select("z", "col", (F.col("v") - F.col("b")).alias("d")), "d")


@query("circular_roll", f"SELECT z, (col + 61) % 64 AS col, v FROM ({CELLS})")
def circular_roll(spark, d):
    return cells(spark, d).select("z", F.pmod(F.col("col") - 3, F.lit(64)).alias("col"), "v")


@query("nearest_winding", """
WITH k AS (SELECT unnest(range(10)) AS k), e AS (SELECT event_id, k, abs(value - (24.0 + 50.0 * k)) AS d FROM events CROSS JOIN k)
SELECT event_id, k AS winding, round(d, 6) AS error FROM e QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, k) = 1""")  # fmt: skip
def nearest_winding(spark, d):
    """Point to the winding of least radius error; the few windings are an array, not a join."""
    options = F.array(*[F.struct(F.abs(F.col("value") - (24.0 + 50.0 * k)).alias("d"), F.lit(k).cast("long").alias("k")) for k in range(10)])
    best = events(spark, d).select("event_id", F.array_min(options).alias("b"))
    return r6(best.select("event_id", F.col("b.k").alias("winding"), F.col("b.d").alias("error")), "error")


@query("window_of_largest_spread", f"""
WITH c AS ({CELLS}), s AS (SELECT z, col, stddev_pop(v) OVER (PARTITION BY z ORDER BY col ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS s FROM c)
SELECT z, col, round(s, 6) AS spread FROM s WHERE col <= 48 QUALIFY row_number() OVER (PARTITION BY z ORDER BY round(s, 9) DESC, col) = 1""")  # fmt: skip
def window_of_largest_spread(spark, d):
    s = cells(spark, d).withColumn("spread", F.stddev_pop("v").over(Window.partitionBy("z").orderBy("col").rowsBetween(0, 15))).where("col <= 48")
    return r6(s.withColumn("k", F.row_number().over(sem.ordered(["z"], F.desc(F.round("spread", 9)), "col"))).where("k = 1").select("z", "col", "spread"), "spread")


