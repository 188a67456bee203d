"""Contiguous sharding of atomic groups with the smallest possible largest shard.

Groups (equal texts) stand in one order, by their smallest id. The capacity of the largest shard
is found by bisection: a capacity is feasible if filling shards greedily, each as far as it goes,
needs no more than the given number. Greedy filling leaves the last shards short, so the cuts are
then spread: within the capacity found, each is put near an even share of what is left. The order never comes to one place. The driver holds a ladder
of prefix sums, at most LADDER cells with the first and last sum in each, and bisects between what
the ladder proves feasible and what it proves infeasible. Where the two differ, the cells around
the possible cuts are divided again, until the cuts are exact: a pass for each ladder, and with
fewer groups than cells around the cuts the second is the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lamina.llm.common import forget, free, save, shuffle_partitions, small_batches

#: Cells of a ladder: rows that come to the driver in one pass, two for each shard in addition.
LADDER = 65_536
_KEY = ("gid", "h1", "h2")


def _running(value: str, out: str, inclusive: bool):
    """For mapInArrow: the running sum of ``value`` over a partition, as column ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            v = b[value].to_numpy()
            s = total + np.cumsum(v, dtype=np.int64)
            total = int(s[-1]) if len(s) else total
            yield b.append_column(out, pa.array(s if inclusive else s - v))

    return run


def _with_prefix(df: DataFrame, by: list, value: str, out: str, inclusive: bool, name: str) -> tuple[DataFrame, dict[int, int], int, int]:
    """``df`` in range partitions ordered by ``by``, with a running sum inside each partition and
    the partition's number as column block; each block's start, the total and the largest value.
    These are one number for each shuffle partition."""
    spark = df.sparkSession
    df = df.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by).withColumn("block", F.spark_partition_id())
    schema = StructType([*df.schema.fields, StructField(out, LongType())])
    df = save(df.mapInArrow(_running(value, out, inclusive), schema), name)
    sums = {r[0]: (r[1], r[2]) for r in df.groupBy("block").agg(F.sum(value), F.max(value)).collect()}
    starts, total = {}, 0
    for block in sorted(sums):
        starts[block] = total
        total += sums[block][0]
    return df, starts, total, max((m for _, m in sums.values()), default=0)


def _starts_column(starts: dict[int, int], block="block"):
    """The start of a row's block: one literal for each shuffle partition."""
    ordered = [starts.get(i, 0) for i in range(max(starts, default=0) + 1)]
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in ordered]), F.col(block) + 1) if ordered else F.lit(0).cast("long")


class Ladder:
    """Some of the prefix sums, in order, from 0 to the total; after some of them others follow
    that are not known (``dark``)."""

    def __init__(self, total: int):
        self.points, self.dark = np.array([0, total], np.int64), np.array([True, False])

    def _at(self, target: int) -> int:
        return int(np.searchsorted(self.points, target, side="right")) - 1

    def low(self, target: int) -> int:
        """A sum that does not exceed the target, the largest that is known."""
        return int(self.points[self._at(target)])

    def high(self, target: int) -> int:
        """No sum that does not exceed the target is larger than this."""
        i = self._at(target)
        return min(target, int(self.points[i + 1]) - 1) if self.dark[i] else int(self.points[i])

    def gap(self, least: int, most: int) -> tuple[int, int] | None:
        """The known sums around all unknown ones that targets from least to most could meet."""
        i, j = self._at(least), self._at(most)
        dark = i + np.flatnonzero(self.dark[i : j + 1])
        return (int(self.points[dark[0]]), int(self.points[dark[-1] + 1])) if len(dark) else None

    def learn(self, ranges: list[tuple[int, int]], cells: list[tuple[int, int, int]]) -> None:
        """``cells``: first and last sum and how many, of cells that cover the open ranges."""
        keep = np.ones(len(self.points), bool)
        for a, b in ranges:
            keep &= (self.points <= a) | (self.points >= b)
        points, dark = self.points[keep], self.dark[keep]
        for a, _ in ranges:
            dark[np.searchsorted(points, a)] = False
        new = {}
        for first, last, n in cells:
            new[last] = False
            new[first] = n > 2
        points = np.concatenate([points, np.fromiter(new.keys(), np.int64, len(new))])
        dark = np.concatenate([dark, np.fromiter(new.values(), bool, len(new))])
        order = np.argsort(points)
        self.points, self.dark = points[order], dark[order]


    def floor(self, target: int, open_: set) -> int:
        """The largest known sum up to the target; ``open_`` gets what is around it if others are not known."""
        i = self._at(target)
        if self.dark[i] and self.points[i] < target:
            open_.add((int(self.points[i]), int(self.points[i + 1])))
        return int(self.points[i])

    def ceil(self, target: int, open_: set) -> int:
        """The smallest known sum from the target on, likewise."""
        i = int(np.searchsorted(self.points, target))
        if self.points[i] > target and self.dark[i - 1]:
            open_.add((int(self.points[i - 1]), int(self.points[i])))
        return int(self.points[i])


def _fill(reach, total: int, capacity: int, shards: int) -> list[int]:
    """Where greedily filled shards end; the last is the total if the capacity is feasible."""
    ends, at = [], 0
    for _ in range(shards):
        at = reach(min(total, at + capacity))
        ends.append(at)
    return ends


def _least(low: int, high: int, feasible) -> int:
    """The smallest feasible number from low to high, given that high is."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def _joined(gaps) -> list[tuple[int, int]]:
    ranges: list[tuple[int, int]] = []
    for a, b in sorted(gaps):
        if ranges and a < ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
        else:
            ranges.append((a, b))
    return ranges


def _look(ladder: Ladder, divide, ranges: list[tuple[int, int]]) -> None:
    every = sum(b - a for a, b in ranges)
    ladder.learn(ranges, divide(ranges, [max(1, -(-every // LADDER))] * len(ranges)))


def _spread(ladder: Ladder, divide, total: int, capacity: int, shards: int) -> list[int]:
    """Ends of shards within a feasible capacity, each as near as may be to an even share of what is left
    (the smaller of two equally near ones), but so that the shards behind it can hold the rest."""
    while True:
        open_: set[tuple[int, int]] = set()
        first = [total]  # from where on one shard, two, ... can hold the rest
        for _ in range(shards - 1):
            first.append(ladder.ceil(max(0, first[-1] - capacity), open_))
        ends, at = [], 0
        for left in range(shards, 1, -1):
            top = ladder.floor(min(total, at + capacity), open_)
            even = min(at + -(-(total - at) // left), top)
            near = [x for x in (ladder.floor(even, open_), ladder.ceil(even, open_)) if first[left - 1] <= x <= top]
            at = min(near, key=lambda x: (abs(x - even), x), default=max(at, min(first[left - 1], top)))
            ends.append(at)
        if not open_:
            return [*ends, total]
        _look(ladder, divide, _joined(open_))


def minimax_cuts(divide, total: int, largest: int, shards: int, spread: bool = False) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the prefix sums at which greedily filled shards end, or,
    ``spread``, those of _spread() within that capacity. ``divide`` gets open ranges and the width of
    each one's cells, and returns those that hold sums as (first sum, last sum, how many)."""
    if not total:
        return 0, [0] * shards
    ladder, ranges = Ladder(total), [(0, total)]
    least = max(largest, -(-total // shards))
    while True:
        _look(ladder, divide, ranges)
        sure = _least(least, total, lambda c: _fill(ladder.low, total, c, shards)[-1] == total)
        least = _least(least, sure, lambda c: _fill(ladder.high, total, c, shards)[-1] == total)
        low, high = _fill(ladder.low, total, least, shards), _fill(ladder.high, total, sure, shards)
        if least == sure and low == high:
            return sure, _spread(ladder, divide, total, sure, shards) if spread else low
        ranges = _joined(g for a, b in zip([0, *low], [0, *high], strict=True) if (g := ladder.gap(min(total, a + least), min(total, b + sure))))


def _divider(groups: DataFrame, starts: dict[int, int]):
    """What minimax_cuts() asks for, from one pass over the groups."""
    at = _starts_column(starts) + F.col("prefix")

    def divide(ranges: list[tuple[int, int]], widths: list[int]) -> list[tuple[int, int, int]]:
        cell = lambda r, a, w: F.struct(F.lit(r).alias("r"), F.floor((F.col("sum") - F.lit(a)) / F.lit(w)).alias("c"))
        where = F.coalesce(*[F.when((F.col("sum") > F.lit(a)) & (F.col("sum") < F.lit(b)), cell(r, a, w)) for r, ((a, b), w) in enumerate(zip(ranges, widths, strict=True))])
        found = groups.select(at.alias("sum")).withColumn("cell", where).where("cell IS NOT NULL").groupBy("cell").agg(F.min("sum"), F.max("sum"), F.count("*"))
        return [(int(r[1]), int(r[2]), int(r[3])) for r in found.collect()]  # about LADDER rows at most

    return divide


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """``docs`` with columns size, text_crc32, shard and slot.

    A row's size is the UTF-8 bytes of its text (null: none) plus ``overhead``. Rows with equal
    texts (null equals null, not the empty text) are a group and share a shard. Groups stand in
    the order of their smallest id (groups without one first; ties by the text's hash); shards are
    contiguous in that order, and the largest is as small as contiguity and whole groups allow; within
    that capacity each cut lies as near to an even share of the rest as it can. A slot counts a shard's rows from 0, in the order of groups, then of ids (null first), then of a
    hash of the other columns.

    Empty and null texts are groups like any other. Repeated rows each get a slot. Empty table:
    no rows. A group may outweigh all the rest; some shards may then be empty. The text is not
    carried along; other columns pass through, and a new column whose name is taken gets an underscore.
    """
    small_batches(docs.sparkSession)
    own = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    text = F.col(own[text_col])
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    renamed = docs.select([F.col(c).alias(n) for c, n in own.items()])
    rest = [n for c, n in own.items() if c != text_col]
    rows = renamed.select(*rest, F.col(own[id_col]).cast("long").alias("id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.xxhash64(text, text.isNull()).alias("h1"), F.xxhash64(F.lit(1), text, text.isNull()).alias("h2"))
    rows = save(rows, "shard-rows")
    firsts = rows.groupBy("h1", "h2").agg(F.min("id").alias("gid"), F.sum("size").alias("bytes"))
    groups, starts, total, largest = _with_prefix(firsts, list(_KEY), "bytes", "prefix", True, "shard-groups")
    _, ends = minimax_cuts(_divider(groups, starts), total, largest, shards, spread=True)
    ends = sorted({e for e in ends if 0 < e < total})
    after = _starts_column(starts) + F.col("prefix")
    # each cut's last group: its key tells where the next shard starts; at most `shards` rows
    cut_keys = [tuple(r) for r in groups.where(after.isin(ends)).select(*_KEY).collect()] if ends else []
    key = F.struct("gid", "h1", "h2")
    literal = lambda k: F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(k, _KEY, strict=True)])
    shard = sum(((key > literal(k)).cast("int") for k in cut_keys), F.lit(0)).cast("int")
    placed = rows.join(groups.select(*_KEY), ["h1", "h2"]).withColumn("one", F.lit(1).cast("long"))
    hashed = [f.name for f in placed.schema.fields if f.name in rest and "map<" not in f.dataType.simpleString()]
    placed, row_starts, _, _ = _with_prefix(placed, [*_KEY, "id", F.xxhash64(*hashed)], "one", "local", False, "shard-places")
    forget(rows, groups)
    placed = placed.withColumn("shard", shard).withColumn("nth", _starts_column(row_starts) + F.col("local"))
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("nth")).collect()}
    start = F.element_at(F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)]), F.col("shard") + 1)
    new = {"size": F.col("size"), "text_crc32": F.col("crc"), "shard": F.col("shard"), "slot": F.col("nth") - start}
    return placed.select(*[F.col(own[c]).alias(c) for c in docs.columns if c != text_col], *[x.alias(free(docs, c)) for c, x in new.items()])
