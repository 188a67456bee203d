"""Joins by nearness: as-of, banded, interval, one-to-one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.semantics import finite, ordered, rint
from lamina.sources.scratch import settle


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, columns: list[str], forward: bool = False, tolerance: float | None = None) -> DataFrame:
    """Each left row with the last right row at or before it (or the first at or after): one union
    and one window, no range join. Adds ``columns`` and <at>_right; NULL where nothing qualifies."""
    own = [c for c in left.columns if c not in keys and c != at]
    none = lambda df, cs: [F.lit(None).cast(df.schema[c].dataType).alias(f"_r_{c}") for c in cs]
    lhs = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*own).alias("_l") if own else F.struct(F.lit(0)).alias("_l"), *none(right, columns), F.lit(None).cast(right.schema[at].dataType).alias("_rt"))
    rhs = right.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(lhs.schema["_l"].dataType).alias("_l"), *[F.col(c).alias(f"_r_{c}") for c in columns], F.col(at).alias("_rt"))
    both = lhs.union(rhs)
    w = ordered(keys, F.desc("_t"), "_side") if forward else ordered(keys, "_t", "_side")
    seen = F.last(F.when(F.col("_side") == 0, F.struct("_rt", *[f"_r_{c}" for c in columns])), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("_m", seen).where("_side = 1")
    hit = F.col("_m").isNotNull()
    if tolerance is not None:
        hit = hit & (F.abs(F.col("_m._rt") - F.col("_t")) <= tolerance)
    return rows.select(*keys, F.col("_t").alias(at), *[F.col(f"_l.{c}").alias(c) for c in own], *[F.when(hit, F.col(f"_m._r_{c}")).alias(c) for c in columns], F.when(hit, F.col("_m._rt")).alias(f"{at}_right"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, columns: list[str], tolerance: float | None = None) -> DataFrame:
    """The nearest right row in either direction, the earlier one on ties; ``at`` is numeric."""
    back = asof(left, right, keys, at, columns)
    renamed = [c for c in back.columns if c in columns or c == f"{at}_right"]
    back = back.withColumnsRenamed({c: f"_b_{c}" for c in renamed})
    both = asof(back, right, keys, at, columns, forward=True)
    a, b = F.abs(F.col(at) - F.col(f"_b_{at}_right")), F.abs(F.col(f"{at}_right") - F.col(at))
    earlier = F.coalesce(a <= b, a.isNotNull())
    chosen = {c: F.when(earlier, F.col(f"_b_{c}")).otherwise(F.col(c)) for c in renamed}
    out = both.withColumn("_keep", F.struct(*[v.alias(c) for c, v in chosen.items()])).drop(*renamed, *[f"_b_{c}" for c in renamed])
    near = F.lit(True) if tolerance is None else F.abs(F.col(f"_keep.{at}_right") - F.col(at)) <= tolerance
    return out.select(*[c for c in out.columns if c != "_keep"], *[F.when(near, F.col(f"_keep.{c}")).alias(c) for c in renamed])


def banded(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, width: float) -> DataFrame:
    """All pairs at most ``width`` apart: an equi-join on buckets of that width and the two next to
    them, not a nested loop."""
    b = lambda c: F.floor(F.col(c) / width).cast("long")
    lhs = left.withColumn("_bucket", F.explode(F.sequence(b(left_at) - 1, b(left_at) + 1)))
    rhs = right.withColumn("_bucket", b(right_at))
    return lhs.join(rhs, [*keys, "_bucket"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= width).drop("_bucket")


def best_in_band(pairs: DataFrame, keys: list[str], score: Column, *ties) -> DataFrame:
    """One pair for each key: the best score, the first on ties."""
    return pairs.withColumn("_n", F.row_number().over(ordered(keys, score.desc(), *ties))).where("_n = 1").drop("_n")


#: Rows in a pack of ``interval``. Its pairs come pack by pack, so one column repeats a value and the other a
#: sequence of so many: Parquet writes both shortly, if a page (20,000 rows) holds the sequence often.
PACK = 128


def interval(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str, bucket: float) -> DataFrame:
    """Points inside half-open intervals [lo, hi), by equi-join on buckets. Without keys, points that lie
    outside all intervals are dropped before they are shuffled, by one row with the ends of the whole.
    In a bucket points and intervals are packed in order, PACK in a row, and packs that overlap are
    unpacked: all pairs, in an order that columnar files keep small. Packs are merged, since intervals
    repeated for their buckets are larger than the estimate that would have them broadcast."""
    b = lambda c: F.floor(F.col(c) / bucket).cast("long")
    s = spans.where(F.col(hi) > F.col(lo))
    p = points.where(F.col(at).isNotNull())
    if not keys:
        ends = s.agg(F.min(lo).alias("_lo"), F.max(hi).alias("_hi"))
        p = p.join(F.broadcast(ends), (F.col(at) >= F.col("_lo")) & (F.col(at) < F.col("_hi"))).drop("_lo", "_hi")
    cells = [*keys, "_bucket"]

    def packs(df, name, first, last):
        rest = [c for c in df.columns if c not in cells]
        n = F.row_number().over(ordered(cells, first, last))
        return df.withColumn("_n", F.floor((n - 1) / PACK)).groupBy(*cells, "_n").agg(F.min(first).alias(f"{name}_first"), F.max(last).alias(f"{name}_last"), F.collect_list(F.struct(*rest)).alias(name)).drop("_n"), [f"{name}.{c}" for c in rest]

    s, spans_own = packs(s.withColumn("_bucket", F.explode(F.sequence(b(lo), b(hi)))), "_s", lo, hi)
    p, points_own = packs(p.withColumn("_bucket", b(at)), "_p", at, at)
    pairs = s.hint("merge").join(p, cells).where((F.col("_p_last") >= F.col("_s_first")) & (F.col("_p_first") < F.col("_s_last")))
    pairs = pairs.withColumn("_s", F.filter("_s", lambda x: (F.col("_p_last") >= x[lo]) & (F.col("_p_first") < x[hi])))
    pairs = pairs.withColumn("_s", F.explode("_s")).withColumn("_p", F.explode("_p"))
    return pairs.where((F.col(f"_p.{at}") >= F.col(f"_s.{lo}")) & (F.col(f"_p.{at}") < F.col(f"_s.{hi}"))).select(*keys, *points_own, *spans_own)


def mutual_nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, left_at: str, right_at: str, width: float) -> DataFrame:
    """Pairs within ``width`` that are each other's nearest (ties: the smaller id)."""
    pairs = banded(left, right, keys, left_at, right_at, width).withColumn("gap", F.abs(F.col(left_at) - F.col(right_at)))
    pairs = pairs.withColumns({"_a": F.row_number().over(ordered([*keys, left_id], "gap", right_id)), "_b": F.row_number().over(ordered([*keys, right_id], "gap", left_id))})
    return pairs.where("_a = 1 AND _b = 1").drop("_a", "_b")


def linear_map(n_left: int, n_right: int):
    """For a DataFrame of i in 0 .. n_left - 1: the proportional index, rounded half to even."""
    scale = (n_right - 1) / (n_left - 1) if n_left > 1 else 0.0
    return lambda i: rint(i * scale).cast("int")


def collapse_map(pairs: DataFrame, all_ids: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """A many-to-one map made a function: the truncated median of an index's partners, -1 without."""
    m = pairs.groupBy(*keys, left).agg(F.floor(F.percentile(F.col(right), F.lit(0.5))).cast("int").alias(right))
    return all_ids.join(m, [*keys, left], "left").withColumn(right, F.coalesce(right, F.lit(-1)))


def pair_exact(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with a partner, and those of either side without one."""
    return left.join(right, keys), left.join(right, keys, "left_anti"), right.join(left, keys, "left_anti")


def alignment_offset(left: DataFrame, right: DataFrame, keys: list[str], index: str, at: str, tolerance: float, least: int = 10) -> DataFrame:
    """The median difference of index between marks matched by place; 0 with fewer than ``least``."""
    r = right.select(*keys, at, F.col(index).alias("_ri"))
    m = nearest(left.select(*keys, at, index), r, keys, at, ["_ri"], tolerance).where("_ri IS NOT NULL")
    off = m.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(F.col("_ri") - F.col(index), F.lit(0.5)).alias("_o"))
    return off.select(*keys, "n", F.when(F.col("n") < least, F.lit(0.0)).otherwise(F.col("_o")).alias("offset"))


def nearest_in_plane(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, columns: list[str], cell: float | None = None) -> DataFrame:
    """Each left row with ``columns`` of the nearest right row of its key in the plane, and ``distance``;
    of equally near ones the one whose columns come first in order.

    Right rows lie in square cells; a left row looks into the nine around it. What it finds there is
    proven nearest if no nearer point could lie beyond them. Rows without proof go on with cells
    twice as wide, so a level is one equi-join and levels number the logarithm of the extent. ``cell``
    is the first width; by default right rows average one a cell. Right rows at one place count once.
    NULL or NaN coordinates find nothing and are not found; left rows without a right row in their
    key get NULL. Left rows may repeat."""
    taken = {c.lower() for c in left.columns}
    if taken & {c.lower() for c in (*columns, "distance")}:
        raise ValueError("left has a column of that name")
    ok = lambda df: df.where(finite(F.col(x)).isNotNull() & finite(F.col(y)).isNotNull())
    spots = ok(right).groupBy(*keys, F.col(x).cast("double").alias("_rx"), F.col(y).cast("double").alias("_ry")).agg(F.min(F.struct(*columns)).alias("_c"))
    spots = settle(spots)
    if cell is None:
        n, x0, x1, y0, y1 = spots.agg(F.count("*"), F.min("_rx"), F.max("_rx"), F.min("_ry"), F.max("_ry")).first()
        extent = max((x1 - x0), (y1 - y0)) if n else 0.0
        cell = max(math.sqrt(max((x1 - x0), extent / 1024) * max((y1 - y0), extent / 1024) / n), extent * 1e-6) if extent else 1.0
    asked = ok(left).select(*keys, F.col(x).cast("double").alias("_lx"), F.col(y).cast("double").alias("_ly")).distinct()
    open_ = asked.join(spots.select(*keys).distinct(), keys, "left_semi") if keys else asked if not spots.isEmpty() else asked.limit(0)
    at = lambda c, s: F.floor(F.col(c) / s)
    done = None
    while True:
        around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
        cells = open_.withColumn("_dx", around).withColumn("_dy", around)
        cells = cells.select(*keys, "_lx", "_ly", (at("_lx", cell) + F.col("_dx")).alias("_cx"), (at("_ly", cell) + F.col("_dy")).alias("_cy"))
        there = spots.withColumns({"_cx": at("_rx", cell), "_cy": at("_ry", cell)})
        d2 = (F.col("_lx") - F.col("_rx")) ** 2 + (F.col("_ly") - F.col("_ry")) ** 2
        best = cells.join(there, [*keys, "_cx", "_cy"]).groupBy(*keys, "_lx", "_ly").agg(F.min(F.struct(d2.alias("d"), F.col("_c").alias("c"))).alias("_b"))
        room = lambda c: F.least(F.col(c) - (at(c, cell) - 1) * cell, (at(c, cell) + 2) * cell - F.col(c))
        seen = settle(open_.join(best, [*keys, "_lx", "_ly"], "left").withColumn("_proven", F.coalesce(F.sqrt("_b.d") < F.least(room("_lx"), room("_ly")), F.lit(False))))
        proven = seen.where("_proven").select(*keys, "_lx", "_ly", "_b")
        done = proven if done is None else done.union(proven)
        open_ = seen.where("NOT _proven").select(*keys, "_lx", "_ly")
        if open_.isEmpty():
            break
        cell *= 2
    q = left.withColumns({"_lx": F.col(x).cast("double"), "_ly": F.col(y).cast("double")})
    out = q.join(done, [*keys, "_lx", "_ly"], "left")
    return out.select(*left.columns, *[F.col(f"_b.c.{c}").alias(c) for c in columns], F.sqrt("_b.d").alias("distance"))
