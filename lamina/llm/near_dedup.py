"""Near-duplicate documents by HyperMinHash sketches of their word shingles.

A sketch deals a document's shingle hashes to BUCKETS buckets and keeps of each bucket's smallest
hash the count of leading zeros and ten bits of mantissa: a 16-bit register. An empty bucket
borrows the register of another, chosen by fixed priorities. Bands of registers propose pairs,
registers that agree estimate their Jaccard similarity (corrected for chance collisions), and
full shingle sets confirm them.

Equal sets are one node from the start. In each band's bucket every node is first paired with the
bucket's best connected node alone; the pair of each node that shares most bands is estimated and
confirmed, and components are formed. Where that leaves many pairs in buckets of several
components, the nodes outside a bucket's largest component get pivots of their own, and so on. The
nodes still outside are then compared with all of their bucket, in blocks, each pair in the first
band it shares. So large groups of near copies don't cost all their pairs, and no linked pair that
shares a band goes untested. With 38 bands of 5, a pair at similarity 0.8 shares none with
probability 3e-7.

Hot groups: exact copies meet as partial minima; a bucket that holds a large part of all nodes is
a key of joins between two exchanges, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import WordHashes, drop, forget, free, in_worker, mix64, park, portions, save, small_batches
from lamina.llm.components import connected_components
from lamina.llm.shingles import shingle_set

BANDS, ROWS, MANTISSA = 38, 5, 10
BUCKETS = BANDS * ROWS
#: Bytes of text sketched at once; nodes of a bucket compared at once, and their shingles; standard deviations that
#: an estimate may fall short of the threshold (of BUCKETS independent registers).
TEXT_BYTES, BLOCK, BLOCK_SHINGLES, SLACK = 4 << 20, 256, 400_000, 6
#: Pairs a node that may be left to blocks before more pivots are tried, and rounds of these.
PAIRS, ROUNDS = 200, 4
#: Registers of independent sets agree with probability 4 * CHANCE / 2**MANTISSA * ab / (a+b)**2.
CHANCE = 0.169919
_PAIR = "a long, b long"


def _priorities() -> np.ndarray:
    i = np.arange(BUCKETS, dtype=np.uint64)
    return mix64(i[:, None] * np.uint64(1 << 20) + i[None] + np.uint64(77))


def sketch(shingles: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """The registers of a set that isn't empty."""
    h = mix64(shingles + np.uint64(0x51ED2701))
    bucket = (((h >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)).astype(np.int64)
    low = np.full(BUCKETS, 2**64 - 1, np.uint64)
    np.minimum.at(low, bucket, mix64(h ^ np.uint64(0xABCDEF)) >> np.uint64(1))
    full = low < 2**63
    zeros = 63 - np.frexp(np.maximum(low, 1).astype(np.float64))[1].astype(np.int64)  # of 63 bits
    zeros = np.clip(zeros, 0, 62)
    mantissa = (low << (zeros + 2).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    regs = (zeros << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    if not full.all():
        have = np.flatnonzero(full)
        empty = np.flatnonzero(~full)
        regs[empty] = regs[have[np.argmin(priority[np.ix_(empty, have)], axis=1)]]
    return regs


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, priority = in_worker("shingle words", WordHashes), _priorities()
        for b in portions(batches, "text", TEXT_BYTES):
            n, key, regs = [], [], []
            for text in b["text"].to_pylist():
                s = shingle_set(text or b"", size, words)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                regs.append(sketch(s, priority).tobytes() if len(s) else None)
            yield pa.record_batch({"row": b["row"], "n": pa.array(n, pa.int32()), "set_key": pa.array(key, pa.binary()), "regs": pa.array(regs, pa.binary())})

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = in_worker("shingle words", WordHashes)
        for b in portions(batches, "text", TEXT_BYTES):
            found = [shingle_set(t or b"", size, words).view(np.int64) for t in b["text"].to_pylist()]
            yield pa.record_batch({"id": b["id"], "shingles": pa.array(found, pa.list_(pa.int64()))})

    return run


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, len(whole), 2048):
            b = whole.slice(lo, 2048)
            regs = _registers(b["regs"]).astype(np.uint64).reshape(-1, BANDS, ROWS)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), regs.shape[:2])
            for k in range(ROWS):
                key = mix64(key * np.uint64(1 << 16) + regs[:, :, k])
            yield pa.record_batch({"key": pa.array(key.ravel().view(np.int64)), "band": pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(b))), "id": pa.array(np.repeat(b["id"].to_numpy(), BANDS))})


def estimate(same: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of registers that agree, without chance collisions."""
    chance = 4 * CHANCE / 2**MANTISSA * na * nb / (na + nb) ** 2
    return (same - chance) / (1 - chance)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = (_registers(b["regs_a"]) == _registers(b["regs_b"])).mean(axis=1) if len(b) else np.zeros(0)
        na, nb = (b[c].to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
        yield pa.record_batch({"a": b["a"], "b": b["b"], "score": pa.array(estimate(same, na, nb))})


def _candidates(table: pa.Table, floor: float, percent: int) -> np.ndarray:
    """Pairs (rows of side 0, rows of side 1, estimate) of different components in one pair of a
    bucket's blocks that may be similar enough and meet in no earlier band."""
    ids, part, n, outside, side = (table[c].to_numpy() for c in ("id", "component", "n", "outside", "side"))
    band, regs = table["band"][0].as_py(), _registers(table["regs"])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found = [np.zeros((3, 0))]
    for lo in range(0, len(left), 32):
        rows = left[lo : lo + 32]
        lengths = 100 * np.minimum(n[rows, None], n[None, right]) >= percent * np.maximum(n[rows, None], n[None, right])
        once = ~outside[None, right] | (ids[rows, None] < ids[None, right])  # two outside meet twice
        i, j = np.nonzero((part[rows, None] != part[None, right]) & lengths & once)
        for at in range(0, len(i), 4096):
            p, q = rows[i[at : at + 4096]], right[j[at : at + 4096]]
            same = regs[p] == regs[q]
            score = estimate(same.mean(axis=1), n[p].astype(float), n[q].astype(float))
            first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            found.append(np.stack([p, q, score])[:, first & (score >= floor)])
    return np.concatenate(found, axis=1)


def _promising(floor: float, percent: int):
    """The rows of a pair of blocks that are in some candidate."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return table.take(pa.array(np.unique(_candidates(table, floor, percent)[:2]).astype(np.int64)))

    return run


def _cross(floor: float, percent: int):
    """Links between components in one pair of a bucket's blocks. Candidates are taken by falling
    estimate and confirmed on their full sets; one whose components earlier links have connected
    needs no test. Gives pairs of components."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        part = table["component"].to_numpy()
        column = table["shingles"].chunk(0)
        flat, bounds = column.flatten().to_numpy(), column.offsets.to_numpy()
        shingles = [flat[lo - bounds[0] : hi - bounds[0]] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
        p, q, score = _candidates(table, floor, percent)
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        links = []
        for k in np.argsort(-score, kind="stable"):
            i, j = int(p[k]), int(q[k])
            a, b = top(int(part[i])), top(int(part[j]))
            if a != b:
                common = len(np.intersect1d(shingles[i], shingles[j], assume_unique=True))
                if 100 * common >= percent * (len(shingles[i]) + len(shingles[j]) - common):
                    root[max(a, b)] = min(a, b)
                    links.append((part[i], part[j]))
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a, b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in ("a", "b"))
    both = pairs.select("a", "b").join(b, "b").join(a, "a")
    both = both.withColumn("common", F.size(F.array_intersect("set_a", "set_b")).cast("long"))
    total = F.size("set_a").cast("long") + F.size("set_b") - F.col("common")
    return both.where(100 * F.col("common") >= percent * total).select("a", "b")


def _best_stars(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """(a, b): each member with the pivot of its buckets that it shares most of them with."""
    stars = members.select("key", "id").join(pivots, "key").where("id <> pivot").groupBy(F.col("id").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("shared"))
    return stars.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("other"))).alias("best")).select("a", (-F.col("best.other")).alias("b"))


def _pivots(members: DataFrame) -> DataFrame:
    """(key, pivot): the member that shares most, over all bands, is nearest to the middle."""
    return park(members.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("other"))).alias("best")).select("key", (-F.col("best.other")).alias("pivot")))


def _mixed(placed: DataFrame) -> DataFrame:
    """Buckets of several components: the largest one, the pairs between the nodes outside it and
    all, and into how many blocks these (x) and those (y) are dealt."""
    each = placed.groupBy("key", "component").agg(F.count("*").alias("many"), F.sum("n").alias("n"))
    whole = each.groupBy("key").agg(F.max(F.struct("many", (-F.col("component")).alias("other"), "n")).alias("top"), F.sum("many").alias("many"), F.sum("n").alias("n"), F.count("*").alias("components")).where("components > 1")
    blocks = lambda many, n: F.greatest(F.ceil(many / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    out, out_n = F.col("many") - F.col("top.many"), F.col("n") - F.col("top.n")
    return park(whole.select("key", (-F.col("top.other")).alias("largest"), (out * F.col("many")).alias("pairs"), blocks(out, out_n).alias("xs"), blocks(F.col("many"), F.col("n")).alias("ys")))


_MEMBER = "key long, band int, x int, y int, side int, id long, component long, outside boolean, n int, regs binary"


def _in_blocks(placed: DataFrame, mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members of mixed buckets, a copy for each pair of blocks that they meet in: those
    outside the largest component (side 0) in one x and every y, all (side 1) in one y and every x."""
    rows = placed.select("key", "band", "id", "component").join(mixed, "key").withColumn("outside", F.col("component") != F.col("largest"))
    rows = rows.join(nodes.select("id", "n", "regs"), "id")
    block = lambda many: F.pmod(F.xxhash64("id"), many).cast("int")
    cell = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    upto = lambda many: F.sequence(F.lit(0), F.col(many) - 1)
    as_all = F.transform(upto("xs"), lambda x: cell(x, block(F.col("ys")), 1))
    as_outside = F.transform(upto("ys"), lambda y: cell(block(F.col("xs")), y, 0))
    cells = F.when(F.col("outside"), F.concat(as_all, as_outside)).otherwise(as_all)
    return rows.withColumn("cell", F.explode(cells)).select("key", "band", "cell.x", "cell.y", "cell.side", "id", "component", "outside", "n", "regs")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with columns n_shingles, component_id and kept.

    A document's set holds its distinct shingles of ``shingle_words`` words; with fewer words, the
    whole sequence as one. Documents with 100 * intersection >= percent * union are linked;
    component_id is the smallest id reachable, itself included; kept marks the document that has
    its component's id.

    Null or empty texts, or texts without words, have an empty set and are linked with nothing.
    Null ids: such a row is linked with nothing, has a null component and is kept. Rows with the
    same id are one document for links, whatever their texts, and are all kept or not. Empty
    table: no rows. Other columns pass through; a new column whose name is taken gets an
    underscore.
    """
    small_batches(docs.sparkSession)
    floor = percent / 100 - SLACK * (0.16 / BUCKETS) ** 0.5
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    text_key = lambda c: F.xxhash64(c, F.octet_length(c))
    sketches = source.select(F.struct("id", text_key(F.col("text")).alias("key")).alias("row"), "text").mapInArrow(_sketches(shingle_words), "row struct<id:long,key:long>, n int, set_key binary, regs binary")
    rows = save(sketches.select("row.id", "row.key", "n", "set_key", "regs"), "near-sketches")
    usable = rows.where("n > 0 AND id IS NOT NULL")
    # rows of one set have the same n and registers, so any of them will do
    nodes = park(usable.groupBy("set_key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("copies")))

    bands = nodes.mapInArrow(_bands, "key long, band int, id long")
    shared = park(bands.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("many")).where("first < last").select("key", "many"))
    found = park(bands.join(shared, "key"))
    degree = found.groupBy("id").agg(F.sum("many").alias("degree")).join(nodes.groupBy("id").agg(F.max("n").alias("n")), "id")
    members = save(found.join(degree, "id").select("key", "band", "id", "degree", "n"), "near-members")
    drop(shared, found)

    wanted = members.select("id").distinct()
    texts = source.join(wanted, "id").withColumn("key", text_key(F.col("text"))).dropDuplicates(["id", "key"]).select("id", "text")
    sets = save(texts.mapInArrow(_sets(shingle_words), "id long, shingles array<long>"), "near-sets")
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    several = park(usable.groupBy("id").agg(F.min("set_key").alias("one"), F.max("set_key").alias("other")).where("one <> other").select("id"))
    links = usable.select("id", "set_key").join(several, "id").join(nodes.select("set_key", F.col("id").alias("b")), "set_key").select(F.col("id").alias("a"), "b")
    parked = [nodes, several]

    outside, tables = members, [members, sets]
    for k in range(ROUNDS):
        pivots = _pivots(outside)
        close = _best_stars(outside, pivots).join(side("a"), "a").join(side("b"), "b").where("100 * least(n_a, n_b) >= %d * greatest(n_a, n_b)" % percent)
        likely = close.mapInArrow(_score, _PAIR + ", score double").where(F.col("score") >= floor)
        parts = connected_components(links.union(_confirmed(likely, sets, percent)), "a", "b")
        links = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
        placed = park(members.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id")))
        mixed = _mixed(placed)
        parked += [pivots, placed, mixed]
        tables.append(parts)
        left = mixed.agg(F.sum("pairs")).first()[0] or 0
        if k + 1 == ROUNDS or left <= PAIRS * members.count():
            break
        outside = placed.join(mixed.select("key", "largest"), "key").where("component <> largest").drop("component", "largest")

    cell = ("key", "band", "x", "y")
    promising = park(_in_blocks(placed, mixed, nodes).groupBy(*cell).applyInArrow(_promising(floor, percent), _MEMBER))
    cross = promising.join(sets, "id").groupBy(*cell).applyInArrow(_cross(floor, percent), _PAIR)
    wider = connected_components(cross, "a", "b")
    parked.append(promising)

    # from components to sets, and from these back to documents; most sets stand alone
    final = nodes.select("set_key", "id", "copies").join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    final = final.join(wider.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").withColumn("least", F.coalesce("least", "component"))
    final = save(final.where("copies > 1 OR least <> id").groupBy("set_key").agg(F.min("least").alias("component")), "near-components")
    drop(*parked)
    forget(*tables, wider)
    alone = "n > 0 AND id IS NOT NULL"
    mine = rows.where(alone).join(final, "set_key", "left").select("id", "key", "n", "component")
    mine = mine.union(rows.where(f"NOT ({alone})").select("id", "key", "n", F.lit(None).cast("long")))
    own = [f"__near_{x}" for x in ("id", "key", "n", "component", "doc", "text")]
    named = mine.groupBy(F.col("id").alias(own[0]), F.col("key").alias(own[1])).agg(F.max("n").alias(own[2]), F.min("component").alias(own[3]))
    named = save(named, "near-result")
    forget(rows, final)
    keyed = docs.withColumns({own[4]: F.col(id_col).cast("long"), own[5]: text_key(F.col(text_col).cast("binary"))})
    out = keyed.join(named, F.col(own[4]).eqNullSafe(F.col(own[0])) & (F.col(own[5]) == F.col(own[1])), "left")
    # a document that is linked with nothing, or has no shingles, is its own component
    component = F.when(F.col(id_col).isNotNull(), F.coalesce(F.col(own[3]), F.col(id_col).cast("long")))
    new = {"n_shingles": F.coalesce(F.col(own[2]), F.lit(0)).cast("long"), "component_id": component, "kept": F.coalesce(component == F.col(id_col).cast("long"), F.lit(True))}
    return out.select(*docs.columns, *[x.alias(free(docs, c)) for c, x in new.items()])
