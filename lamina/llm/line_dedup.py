"""Line deduplication over a sharded minimal perfect hash.

Every line with a long enough key is hashed to 128 bits. All distinct line hashes enter an index:
shards by hash, each a minimal perfect hash with compact arrays: 16-bit fingerprints, document
counts of a byte that saturate at two, and the smallest document id of those keys alone that
several documents hold, in the order of their indices. Lines then probe those arrays: they travel
as (hash, document, position), without their text, to the owner of their shard, which streams them
past its arrays; the count decides whether a line is shared, the id whether it stays. A shard that
a frequent line makes hot is served by several copies of its arrays.

Collisions: a shard takes another seed until its keys' 64-bit mixes differ, so each key has a slot
of its own, and only lines that the index was made from probe it. A fingerprint that differs means
arrays of other lines: an error, not an answer. Keys with equal 128-bit hashes count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import SPACE, ascii_lower, drop, free, mix64, park, save, small_batches
from lamina.llm.perfect_hash import PerfectHash

#: Keys in a shard and probes for one copy of its arrays. The number of shards has a bound, so
#: the table of shard loads can be broadcast; beyond it shards grow.
SHARD_KEYS, COPY_PROBES, MOST_SHARDS = 16_384, 32_768, 65_536
_ARRAYS = "shard int, blob binary"
_HEAD = 32


def _mixed(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    return mix64(h1.view(np.uint64) ^ np.uint64(seed)) + h2.view(np.uint64)


def _pack(h1: np.ndarray, h2: np.ndarray, first: np.ndarray, last: np.ndarray) -> bytes:
    """One shard: a perfect hash of its keys, and its arrays in the order of the index."""
    seed = 0
    while len(np.unique(keys := _mixed(h1, h2, seed))) < len(keys):
        seed += 1
    perfect = PerfectHash(keys)
    order = np.argsort(perfect.index(keys))
    count = (1 + (first < last)[order]).astype(np.uint8)
    kept = first[order][count > 1]
    head = np.array([seed, len(keys), len(kept), 0], np.int64)
    return b"".join([head.tobytes(), kept.tobytes(), h2[order].astype(np.uint16).tobytes(), count.tobytes(), perfect.to_bytes()])


class Shard:
    """What _pack() made."""

    def __init__(self, blob: bytes):
        seed, n, many, _ = np.frombuffer(blob, np.int64, 4).tolist()
        at = _HEAD + 8 * many
        self.seed, self.first = seed, np.frombuffer(blob, np.int64, many, _HEAD)
        self.fingerprint, self.count = np.frombuffer(blob, np.uint16, n, at), np.frombuffer(blob, np.uint8, n, at + 2 * n)
        self.place = np.cumsum(self.count > 1) - 1  # of a shared key's smallest document
        self.perfect = PerfectHash.from_bytes(blob[at + 3 * n :])

    def repeats(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Places of the lines that a smaller document holds too."""
        at = self.perfect.index(_mixed(h1, h2, self.seed))
        if (at < 0).any() or (self.fingerprint[at] != h2.astype(np.uint16)).any():
            raise ValueError("a line probes a shard that was not made from it")
        shared = np.flatnonzero(self.count[at] > 1)
        return shared[self.first[self.place[at[shared]]] != doc[shared]]


def _build(table: pa.Table) -> pa.Table:
    col = lambda c: table[c].to_numpy()
    blob = _pack(col("h1"), col("h2"), col("lo"), col("hi"))
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})


def _serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, copy), the arrays before the probes that they answer."""
    index, owner = None, None
    for b in batches:
        shard, copy = b["shard"].to_numpy(), b["copy"].to_numpy()
        cut = np.flatnonzero((np.diff(shard) != 0) | (np.diff(copy) != 0)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(shard)], strict=True):
            part, who = b.slice(lo, hi - lo), (shard[lo], copy[lo])
            if who != owner:
                owner, index = who, None
            if part["blob"][0].is_valid:
                index, part = Shard(part["blob"][0].as_py()), part.slice(1)
            if not len(part):
                continue
            if index is None:
                raise ValueError(f"no arrays for shard {who}")
            drop = index.repeats(*(part[c].to_numpy() for c in ("h1", "h2", "id")))
            if len(drop):
                yield pa.record_batch({c: part[c].take(pa.array(drop)) for c in ("id", "text_key", "pos")})


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """The lines to drop, as (id, text_key, pos): a line whose key has at least ``min_chars`` code
    points and is found in at least two documents, outside the smallest id that holds it.
    text_key is the xxhash64 of the text, pos counts lines from 0."""
    small_batches(docs.sparkSession)
    key = ascii_lower(F.trim(F.col("line"), F.lit(SPACE)))
    lines = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("pos", "line"))
        .where(F.col("id").isNotNull())
        .withColumn("key", key)
        .where(F.char_length("key") >= min_chars)
        .select("id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )
    lines = park(lines)
    keys = park(lines.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")))
    shards = int(min(MOST_SHARDS, -(-keys.count() // SHARD_KEYS) or 1))
    shard = F.pmod("h1", F.lit(shards)).cast("int").alias("shard")
    arrays = keys.select("h1", "h2", "lo", "hi", shard).groupBy("shard").applyInArrow(_build, _ARRAYS)
    # at most MOST_SHARDS rows
    load = park(keys.groupBy(shard).agg(F.ceil(F.sum("n") / COPY_PROBES).cast("int").alias("copies")))
    arrays = arrays.join(F.broadcast(load), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "blob", *(F.lit(None).cast(t).alias(c) for c, t in (("h1", "long"), ("h2", "long"), ("id", "long"), ("text_key", "long"), ("pos", "int"))))
    probes = lines.select("*", shard).join(F.broadcast(load), "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("id", "pos"), F.col("copies")).cast("int").alias("copy"), F.lit(None).cast("binary").alias("blob"), "h1", "h2", "id", "text_key", "pos")
    both = arrays.unionByName(probes).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("blob").isNull())
    out = save(both.mapInArrow(_serve, "id long, text_key long, pos int"), "line-drops")
    drop(lines, keys, load)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, plus n_lines (before) and n_dropped.

    Texts are split at \\n; a line's key is the line without white space ([\\x20\\x09-\\x0D]) at
    both ends, A-Z lower-cased. A key of at least ``min_chars`` code points that at least two
    documents hold loses all its lines except in the smallest id that holds it.

    Null or empty text: one empty line, kept as an empty text. Null id: the row holds no key, so
    all its lines stay. Rows with the same id are one document: none of them loses a line to
    another. Repeated rows stay repeated. Empty table: no rows. Other columns pass through; if
    ``docs`` has an n_lines or n_dropped, the new column's name gets an underscore.
    """
    drops = duplicate_lines(docs, id_col, text_col, min_chars)
    d = [f"__lines_{i}" for i in range(4)]
    drops = drops.groupBy(F.col("id").alias(d[0]), F.col("text_key").alias(d[1])).agg(F.collect_set("pos").alias(d[2]))
    n_lines, n_dropped = free(docs, "n_lines"), free(docs, "n_dropped")
    lines = F.col(d[3])
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.when(F.col(d[2]).isNull(), F.coalesce(text_col, F.lit(""))).otherwise(F.array_join(F.transform(F.array_except(every, F.col(d[2])), lambda i: F.get(lines, i)), "\n"))
    out = docs.join(drops, (F.col(id_col).cast("long") == F.col(d[0])) & (F.xxhash64(text_col) == F.col(d[1])), "left")
    out = out.withColumn(d[3], F.split(F.coalesce(text_col, F.lit("")), "\n", -1))
    out = out.withColumns({n_lines: F.size(lines).cast("long"), n_dropped: F.coalesce(F.size(F.col(d[2])), F.lit(0)).cast("long"), text_col: kept})
    return out.drop(*d)
