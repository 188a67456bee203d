"""Exact top-k inner-product search with vectors bucketed by length.

Candidates stand in buckets of falling length. A query's k-th best score so far, over the product
of the query's and the bucket's greatest length, is the cosine that a bucket's vectors must reach.
Above 1 it prunes the bucket. A high one prunes by coordinates: a unit vector within that angle of
the query has each coordinate in a known interval around the query's; those of the query's
largest coordinates are looked up in sorted lists. A low one prunes by length: the vectors too
short for the threshold form the bucket's tail. What is left is multiplied out exactly.

Queries come in blocks of thousands, candidates in buckets dealt to strides, both in the narrowest
integers that hold them. A task holds one block and streams one stride of buckets past it, longest
first; all queries of a block that a bucket concerns by length are multiplied with its longer part
at once. The longest bucket of all comes before: the k-th best score in it is where a query's
threshold starts in every stride. It also says how long a candidate must be to matter to the query;
queries are dealt into blocks by that length, and a bucket that is too short for all queries of a block
is never sent to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import drop, forget, park, save, shuffle_partitions, small_batches

#: Queries in a block, vectors in a bucket, candidates in a stride at most, queries multiplied at
#: once.
QUERIES, BUCKET, STRIDE, SIDE = 4096, 1024, 262_144, 512
#: Coordinates looked up, and the local cosine from which they are: below it, the intervals of
#: dense vectors take in nearly all of a bucket.
FOCUS, STEEP = 3, 0.95
_EXACT, _NONE = 2.0**52, -(2**63)
_PACK = "dim int, longest double, width int, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _pack(size: int, bounds: bool = False):
    """Sorted rows into rows of up to ``size`` vectors of one dimension, ``width`` bytes a number. With
    ``bounds`` rows also have a floor, and the length that a candidate needs to reach it: floors
    stay beside the ids, of the lengths the least one tells which buckets can matter at all."""

    def emit(ids: list, vectors: list, floors: list, needs: list):
        i, v = np.concatenate(ids), np.concatenate(vectors)
        longest = float(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1).max()))
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if t is np.int64 or (v.min() >= np.iinfo(t).min and v.max() <= np.iinfo(t).max))
        more = {"floor": pa.array([np.concatenate(floors).tobytes()], pa.binary()), "need": [float(np.concatenate(needs).min())]} if bounds else {}
        return pa.record_batch({"dim": pa.array([v.shape[1]], pa.int32()), "longest": [longest], "width": pa.array([np.dtype(kind).itemsize], pa.int32()), "ids": pa.array([i.tobytes()], pa.binary()), "vectors": pa.array([v.astype(kind).tobytes()], pa.binary()), **more})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, floors, needs, held = [], [], [], [], 0
        for b in batches:
            i, flat = b["id"].to_numpy(), b["v"].flatten().to_numpy()
            floor, need = (b[c].to_numpy() if bounds else i for c in ("floor", "need"))
            at = b["v"].offsets.to_numpy().astype(np.int64)
            at -= at[0] if len(at) else 0
            dims = np.diff(at)
            cut = np.flatnonzero(np.diff(dims)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(dims)], strict=True):
                while lo < hi:
                    if held and (held == size or vectors[0].shape[1] != dims[lo]):
                        yield emit(ids, vectors, floors, needs)
                        ids, vectors, floors, needs, held = [], [], [], [], 0
                    to = min(hi, lo + size - held)
                    ids.append(i[lo:to])
                    floors.append(floor[lo:to])
                    needs.append(need[lo:to])
                    vectors.append(flat[at[lo] : at[to]].reshape(to - lo, -1))
                    lo, held = to, held + to - lo
        if held:
            yield emit(ids, vectors, floors, needs)

    return run


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(row["ids"], np.int64)
    return i, np.frombuffer(row["vectors"], f"<i{row['width']}").astype(np.int64).reshape(len(i), -1)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products [q, p]; in floats where these can't round."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1])
    if most < _EXACT:
        return (q.astype(np.float64) @ p.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return q @ p.T
    exact = q.astype(object) @ p.T.astype(object)
    return np.array([[min(max(int(x), -(2**63)), 2**63 - 1) for x in row] for row in exact], np.int64).reshape(len(q), len(p))


class _Bucket:
    """Vectors of falling length, with their unit vectors' coordinates sorted on demand."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        f = v.astype(np.float64)
        length = np.sqrt((f**2).sum(axis=1))
        order = np.lexsort((ids, -length))
        self.ids, self.v, self.length = ids[order], v[order], length[order]
        self.unit = f[order] / np.maximum(self.length, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_by(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        if c not in self.lists:
            order = np.argsort(self.unit[:, c], kind="stable")
            self.lists[c] = self.unit[order, c], order
        return self.lists[c]

    def by_coordinates(self, unit: np.ndarray, cosine: float, long: int) -> np.ndarray:
        """Places among the ``long`` first of all vectors within the angle of this cosine."""
        counts = np.zeros(len(self.ids), np.int8)
        for c in np.argsort(-np.abs(unit))[:FOCUS]:
            values, order = self.sorted_by(int(c))
            reach = np.sqrt(max(0.0, (1 - cosine**2) * (1 - unit[c] ** 2))) + 1e-9
            lo, hi = np.searchsorted(values, (unit[c] * cosine - reach, unit[c] * cosine + reach))
            # beyond the pole of this coordinate every larger value is nearer still
            if unit[c] >= cosine:
                hi = len(values)
            if -unit[c] >= cosine:
                lo = 0
            counts[order[lo:hi]] += 1
        some = np.flatnonzero(counts == min(FOCUS, len(unit)))
        return some[some < long]


class _Block:
    """A block of queries with each one's best candidates so far. ``least`` is the score that a
    candidate must reach, _NONE while any will do."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        self.least = np.full(len(ids), _NONE, np.int64) if floor is None else floor.copy()
        self.row, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def need(self) -> np.ndarray:
        """The length that a candidate needs at least to reach a query's score; 0 while any may do."""
        return np.where(self.least > 0, self.least.astype(np.float64) / np.maximum(self.length, 1e-300) * (1 - 1e-9), 0.0)

    def meet(self, bucket: _Bucket) -> None:
        bound, need = self.least > 0, self.need()
        live = ~bound | (need <= bucket.length[0])
        cosine = np.minimum(1.0, need / max(bucket.length[0], 1e-300))
        long = np.where(bound, np.searchsorted(-bucket.length, -need, side="right"), len(bucket.ids))
        found = []
        for r in np.flatnonzero(live & bound & (cosine >= STEEP)).tolist():
            some = bucket.by_coordinates(self.q[r] / self.length[r], float(cosine[r]), int(long[r]))
            if len(some):
                found.append((np.full(len(some), r), some, products(self.q[r : r + 1], bucket.v[some])[0]))
        flat = np.flatnonzero(live & ~(bound & (cosine >= STEEP)))
        flat = flat[np.argsort(-long[flat], kind="stable")]
        for lo in range(0, len(flat), SIDE):
            rows = flat[lo : lo + SIDE]
            part = bucket.v[: long[rows[0]]]
            if not len(part):
                continue
            score, least = products(self.q[rows], part), self.least[rows][:, None]
            if len(part) > self.k + 1:  # of one bucket, no more than k besides the query itself
                least = np.maximum(least, np.partition(score, len(part) - self.k - 1, axis=1)[:, -self.k - 1, None])
            r, c = np.nonzero(score >= least)
            found.append((rows[r], c, score[r, c]))
        if found:
            self._take(*(np.concatenate(x) for x in zip(*found, strict=True)), bucket.ids)

    def _take(self, row: np.ndarray, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        vec = ids[place]
        good = (score >= self.least[row]) & (vec != self.ids[row])
        row, vec, score = (np.concatenate(x) for x in ((self.row, row[good]), (self.vec, vec[good]), (self.score, score[good])))
        order = np.lexsort((vec, ~score, row))  # ~: falling, and never out of range
        row, vec, score = row[order], vec[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        self.row, self.vec, self.score = (x[nth < self.k] for x in (row, vec, score))
        last = nth == self.k - 1
        self.least[row[last]] = np.maximum(self.least[row[last]], score[last])


def _search(k: int, seed: bool = False):
    """Blocks against the buckets that follow them: what they found, or, to ``seed``, their queries one
    by one with the least score of each and the length it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = None, None

        def finish():
            if block is None:
                return
            if seed:
                n, dim = block.q.shape
                v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(block.q.ravel()))
                yield pa.record_batch({"id": block.ids, "v": v, "dim": pa.array([dim] * n, pa.int32()), "floor": block.least, "need": block.need()})
            else:
                yield pa.record_batch({"query_id": block.ids[block.row], "vec_id": block.vec, "score": block.score})

        for b in batches:
            for row in b.to_pylist():
                if row["task"] != task:
                    yield from finish()
                    task, block = row["task"], None
                if row["is_query"]:
                    floor = row["floor"]
                    block = _Block(*_unpack(row), k, None if floor is None else np.frombuffer(floor, np.int64))
                else:
                    block.meet(_Bucket(*_unpack(row)))
        yield from finish()

    return run


_SEEDED = "id long, v array<long>, dim int, floor long, need double"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector", counts: dict | None = None) -> DataFrame:
    """Each query's ``k`` highest inner products with the vectors of other ids: query_id, rank
    (from 1), vec_id and score. Ties go to the smaller id. Vectors are arrays of long.

    Null ids, null vectors and vectors with a null component take no part. A query meets vectors
    of its own dimension alone. Of queries that repeat an id, the smallest vector counts; repeated
    candidates each count. With fewer than ``k`` candidates all are returned. Products beyond a
    long stop at its ends. Empty tables give no rows. Other columns are not read. ``counts`` gets the
    pairs of a block and a bucket that are sent to tasks, and how many there could be.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    whole = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    asked = park(whole(queries).groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.size("v").alias("dim")))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n = shuffle_partitions(spark)
    packed = lambda df, parts, size, *by: df.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("id", "v").mapInArrow(_pack(size), _PACK)
    rows = whole(vectors).select("id", "v", F.size("v").alias("dim"), length.alias("length"))
    buckets = save(packed(rows, n, BUCKET, F.col("dim"), F.desc("length"), F.col("id")).withColumn("bucket", F.monotonically_increasing_id()), "topk-buckets")
    parts = min(n, -(-asked.count() // QUERIES) or 1)
    plain = save(packed(asked, parts, QUERIES, F.col("dim"), F.xxhash64("id")).withColumn("block", F.monotonically_increasing_id()), "topk-queries")
    drop(asked)

    columns = ["dim", "longest", "width", "ids", "vectors"]
    as_query = lambda df, floor: df.select("task", "block", F.lit(True).alias("is_query"), *columns, floor.alias("floor"))
    as_bucket = lambda df: df.select("task", F.lit(None).cast("long").alias("block"), F.lit(False).alias("is_query"), *columns, F.lit(None).cast("binary").alias("floor"))
    order = ["task", F.desc("is_query"), F.desc("longest")]
    # one bucket for each dimension
    first = buckets.join(buckets.groupBy("dim").agg(F.max(F.struct("longest", "bucket"))["bucket"].alias("bucket")).select("bucket"), "bucket")
    both = as_query(plain.withColumn("task", F.col("block")), F.lit(None).cast("binary")).union(as_bucket(first.join(plain.select("dim", F.col("block").alias("task")), "dim")))
    seeded = save(both.repartition(n, "task").sortWithinPartitions(*order).mapInArrow(_search(k, seed=True), _SEEDED), "topk-seeded")
    # queries that ask for like lengths stand together, so that a block as a whole can spare itself buckets
    by = [F.col("dim"), F.desc("need"), F.col("id")]
    again = seeded.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("id", "v", "floor", "need")
    blocks = save(again.mapInArrow(_pack(QUERIES, bounds=True), _PACK + ", floor binary, need double").withColumn("block", F.monotonically_increasing_id()), "topk-blocks")
    forget(seeded)
    forget(plain)

    # the stated query set, in blocks, against every bucket that is long enough for some query of the block
    many = buckets.count()
    strides = max(1, min(many, max(-(-many * BUCKET // STRIDE), -(-n // max(1, blocks.count())))))
    tasks = blocks.select("dim", "block", "need", F.explode(F.sequence(F.lit(0), F.lit(strides - 1))).alias("stride")).withColumn("task", F.xxhash64("block", "stride"))
    passing = buckets.withColumn("stride", F.pmod(F.xxhash64("bucket"), F.lit(strides)).cast("int")).join(tasks.select("dim", "stride", "task", "need"), ["dim", "stride"]).where("longest >= need")
    if counts is not None:
        counts["sent"] = passing.count()
        counts["possible"] = sum(r["n"] * r["m"] for r in buckets.groupBy("dim").agg(F.count("*").alias("n")).join(blocks.groupBy("dim").agg(F.count("*").alias("m")), "dim").collect())
    both = as_query(blocks.join(tasks.select("block", "task"), "block"), F.col("floor")).union(as_bucket(passing))
    found = both.repartition(n, "task").sortWithinPartitions(*order).mapInArrow(_search(k), _FOUND)
    # at most k rows of a query from each stride meet here
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
