"""N-best segmentation of texts into SentencePiece pieces, and their decoding.

The piece lattice of a text falls apart at places that no piece crosses: before a space that
follows another character, and around line breaks. In each such segment a forward Viterbi pass
gives the score of the best way to every position; these scores are the exact heuristic of an A*
search that runs backward from the end and meets complete segmentations in falling order of
score. Every rank comes from that search, the first included. Segments are learned in batches:
the forward pass and the search run in step for all segments of a batch, each segment with a
frontier of its own. As the heuristic is exact, each entry of a frontier completes to a
segmentation of just its estimate, so the n best entries are all that a frontier needs.

Order: higher scores first; of equal scores the one with the longer last piece, then with the
longer piece before it, and so on. A segmentation is the set of its inner cuts; as a number with a
bit for each cut, the smaller one goes first. The N best of a text differ from its best only in the
N - 1 segments whose second segmentations come first in that order; lists of these are merged.

Scores are integers (millionths), so sums are exact. A unigram model's scores are its own; a BPE
model stores merge ranks instead, which Zipf's law turns into log probabilities, so the best
segmentation is the likeliest one and not the one that merging by rank gives.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lamina.llm.common import crc32, in_worker, mix64, portions, small_batches

#: Bytes of text taken at once, segments a worker remembers, characters of a segment that is
#: learned in a batch (its cuts are bits of one number), segments in a batch, and the cost of a
#: character without a piece.
TEXT_BYTES, SEGMENTS, SHORT, BATCH, UNKNOWN_COST = 4 << 20, 400_000, 62, 4096, 10.0
UNIT, NEVER, ALL_CUTS = 1_000_000, -(2**60), 2**63 - 1
#: Characters of a batch's segments at most, padded; what a score is above unless it is NEVER and more.
BATCH_CHARS, LOST = 1 << 16, -(2**59)
#: Ends of a longer segment whose edges are held at once; characters and ids that a worker remembers.
BLOCK, REMEMBERED = 4096, 1 << 24
_P = np.uint64(0x100000001B3)
_SLOTS = 20
# Piece types of the model format.
NORMAL, USER_DEFINED, BYTE, UNIGRAM, BPE = 1, 4, 6, 1, 2


class Pieces:
    """A vocabulary: texts of pieces (spaces as spaces), ids, scores, and the bytes' ids."""

    def __init__(self, pieces: dict[str, tuple[int, int]], byte_ids: list[int] | None, unknown_id: int, dummy_prefix: bool, surface: list[bytes]):
        self.pieces, self.byte_ids, self.unknown_id, self.dummy_prefix, self.surface = pieces, byte_ids, unknown_id, dummy_prefix, surface
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((s for _, s in pieces.values()), default=0) - round(UNKNOWN_COST * UNIT)
        self.limit = len(surface)
        crossing = any(re.search("[^ ] ", p) for p in pieces)
        breaks = "" if any("\n" in p for p in pieces) else "\n"
        self.cut = re.compile(r"(?s).+" if crossing else rf" *[^ {breaks}]+| +" + ("|\n" if breaks else ""))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self._tables(hashes, np.array(list(pieces.values()), np.int64).reshape(-1, 2))
        lengths = np.array(list(map(len, surface)), np.int64)
        self.byte_pool, self.byte_len = np.frombuffer(b"".join(surface), np.uint8), lengths
        self.byte_at = np.cumsum(lengths) - lengths

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("models that change the text before cutting it are not supported")
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER_DEFINED)]
        if model.trainer_spec.model_type == BPE:
            total = math.log(sum(1 / (2 - p.score) for _, p in normal))
            score = lambda p: -math.log(2 - p.score) - total
        elif model.trainer_spec.model_type == UNIGRAM:
            score = lambda p: p.score
        else:
            raise ValueError("only unigram and BPE models have scores")
        pieces = {p.piece.replace("▁", " "): (i, round(score(p) * UNIT)) for i, p in normal}
        byte_ids = [i for i, p in enumerate(model.pieces) if p.type == BYTE]
        surface = [p.piece.replace("▁", " ").encode() if p.type in (NORMAL, USER_DEFINED) else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b"" for p in model.pieces]
        return cls(pieces, byte_ids if len(byte_ids) == 256 else None, model.trainer_spec.unk_id, spec.add_dummy_prefix, surface)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _tables(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Two tables of places, the second for pieces whose place in the first is taken; pieces
        that find no place in either stay in a sorted list."""
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")
        self.hash_of, self.id_of, self.score_of = hashes, values[:, 0], values[:, 1]
        self.slots, left = [], np.arange(len(hashes))
        for level in (0, 1, 2):
            table = np.full(1 << _SLOTS, -1, np.int32)
            at = self._slot(hashes[left], level)
            table[at[::-1]] = left[::-1]
            left = left[table[at] != left]
            self.slots.append(table)
        if len(left):
            raise ValueError("no room for a piece in the tables")

    @staticmethod
    def _slot(h: np.ndarray, level: int) -> np.ndarray:
        return (mix64(h + np.uint64(level * 7919)) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash's piece, or -1."""
        out = self.slots[0][self._slot(h, 0)]
        wrong = np.flatnonzero((out >= 0) & (self.hash_of[out] != h))
        for level in (1, 2):
            if not len(wrong):
                break
            found = self.slots[level][self._slot(h[wrong], level)]
            out[wrong] = found
            wrong = wrong[(found >= 0) & (self.hash_of[found] != h[wrong])]
        out[wrong] = -1
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the lattice's edges, [length - 1, start, row], of rows of characters
        as _codes() gives them. A character without a piece has an edge with the id limit + code."""
        codes = np.ascontiguousarray(codes.T)
        n, rows = codes.shape
        most = min(self.longest, n)
        score = np.full((most, n, rows), NEVER, np.int64)
        ids = np.zeros((most, n, rows), np.int32)
        h = np.zeros((n, rows), np.uint64)
        for k in range(most):
            h = h[: n - k] * _P + codes[k:]
            piece = self.find(h.ravel()).reshape(h.shape)
            here = np.flatnonzero((piece >= 0) & (codes[k:] > 0))
            piece = piece.ravel()[here]
            score[k].ravel()[here] = self.score_of[piece]
            ids[k].ravel()[here] = self.id_of[piece]
        bare = (score[0] == NEVER) & (codes > 0)
        score[0][bare] = self.unknown
        ids[0][bare] = self.limit + codes[bare] - 1
        return score, ids

    def spelled(self, ids: list[int]) -> list[int]:
        """Characters without a piece as the ids of their bytes, or as the unknown id."""
        out = []
        for i in ids:
            if i < self.limit:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in chr(i - self.limit).encode()]
            else:
                out.append(self.unknown_id)
        return out


def _codes(segment: str) -> np.ndarray:
    """Code points plus 1; 0 is padding."""
    return np.frombuffer(segment.encode("utf-32-le"), np.uint32) + np.uint32(1)


class Lattice:
    """One segment's lattice, for segments of any length: forward scores are kept, edges are found
    a block of ends at a time, and again where the search comes by."""

    def __init__(self, vocabulary: Pieces, segment: str):
        self.vocabulary, self.n, self.codes = vocabulary, len(segment), _codes(segment)
        self.most = most = min(vocabulary.longest, self.n)
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        # positions stand ``most`` places on, so that every end has as many starts
        self.best = best = np.full(most + self.n + 1, NEVER, np.int64)
        best[most] = 0
        for j in range(1, self.n + 1):
            edge = self._into(j)[0]
            best[most + j] = (best[j : most + j] + edge).max()

    def _into(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the edges into ``j``, by start, from j - most to j - 1."""
        b, at = divmod(j - 1, BLOCK)
        if b not in self._blocks:
            if len(self._blocks) > 1:
                del self._blocks[max(self._blocks, key=lambda x: abs(x - b))]
            lo, hi = b * BLOCK, min(self.n, (b + 1) * BLOCK)
            first = max(0, lo + 1 - self.most)
            score, ids = self.vocabulary.edges(self.codes[None, first:hi])
            by_end = np.full((hi - lo, self.most), NEVER, np.int64), np.zeros((hi - lo, self.most), np.int32)
            ends = np.arange(lo + 1, hi + 1)
            for k in range(len(score)):
                there = ends - k - 1 >= first
                starts = ends[there] - k - 1 - first
                by_end[0][there, self.most - 1 - k] = score[k, starts, 0]
                by_end[1][there, self.most - 1 - k] = ids[k, starts, 0]
            self._blocks[b] = by_end
        score, ids = self._blocks[b]
        return score[at], ids[at]

    def n_best(self, n: int) -> list[tuple[int, int, list[int]]]:
        """The n first segmentations as (score, place by cuts, ids): backward A* whose heuristic,
        the forward score, is exact.

        The frontier holds the n best entries, found ones among them, in the order of their cuts:
        the ways on from an entry take its place, those through longer pieces first, so cuts are
        never compared."""
        frontier: list[tuple[int, int, int, tuple | None]] = [(int(self.best[-1]), self.n, 0, None)]  # estimate, position, score behind it, ids behind it
        while (p := min((k for k, x in enumerate(frontier) if x[1]), key=lambda k: (-frontier[k][0], k), default=None)) is not None:
            _, at, done, link = frontier[p]
            edge, ids = self._into(at)
            through = self.best[at : at + self.most] + edge
            some = np.flatnonzero(through > LOST)
            if len(some) > n:
                some = np.sort(some[np.argsort(-through[some], kind="stable")[:n]])
            ways = [(int(through[c]) + done, at - self.most + c, done + int(edge[c]), (int(ids[c]), link)) for c in some.tolist()]
            frontier[p : p + 1] = ways
            if len(frontier) > n:
                frontier = [frontier[k] for k in sorted(sorted(range(len(frontier)), key=lambda k: (-frontier[k][0], k))[:n])]
        out = []
        for place, (score, _, _, link) in enumerate(frontier):
            ids = []
            while link is not None:
                i, link = link
                ids.append(i)
            out.append((score, place, self.vocabulary.spelled(ids)))
        return sorted(out, key=lambda x: (-x[0], x[1]))


def _first(score: np.ndarray, cuts: np.ndarray, n: int) -> np.ndarray:
    """Places of each row's n first entries, by falling score and then by rising cuts."""
    score, rows, out = score.copy(), np.arange(len(score)), np.empty((len(score), n), np.int64)
    for k in range(n):
        best = score.max(axis=1)
        out[:, k] = at = np.where(score == best[:, None], cuts, ALL_CUTS).argmin(axis=1)
        score[rows, at] = NEVER - 1
    return out


def lockstep_n_best(score: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n first segmentations of each row, as scores and cuts [row, rank]; NEVER where a row has
    fewer. ``score`` is that of Pieces.edges(), ``lengths`` the rows' characters."""
    most, width, many = score.shape
    forward = np.full((width + 1, many), NEVER, np.int64)
    forward[0] = 0
    via = np.full((width + 1, many, most), NEVER, np.int64)  # best score up to an end through a piece of k + 1 characters
    ways = np.empty((most, many), np.int64)
    for j in range(1, width + 1):
        upto = min(most, j)
        for k in range(upto):
            np.add(forward[j - k - 1], score[k, j - k - 1], out=ways[k])
        np.maximum(ways[:upto], NEVER, out=ways[:upto])
        ways[:upto].max(axis=0, out=forward[j])
        via[j, :, :upto] = ways[:upto].T
    via, forward = via.reshape(-1, most), forward.ravel()  # by end, then by row
    found, found_cuts, count = np.full((many, n), NEVER, np.int64), np.zeros((many, n), np.int64), np.zeros(many, np.int64)
    # frontiers: estimates, cuts and positions of up to n entries a row, the first first
    row, keep = np.arange(many), np.full((many, n), NEVER, np.int64)
    keep[:, 0] = forward[lengths * many + row]
    cuts, at = np.zeros((many, n), np.int64), np.zeros((many, n), np.int64)
    at[:, 0] = lengths
    while len(row):
        end = at[:, 0]
        whole = np.flatnonzero(end == 0)
        if len(whole):
            r = row[whole]
            found[r, count[r]], found_cuts[r, count[r]] = keep[whole, 0], cuts[whole, 0]
            count[r] += 1
        here = end * many + row
        through = via[here]
        estimate = np.where(through > LOST, through + (keep[:, 0] - forward[here])[:, None], NEVER)
        # the n first of the ways on: by estimate, and of equal ones the longest piece
        every, more, starts, more_cuts = np.arange(len(row)), np.empty_like(keep), np.empty_like(keep), np.empty_like(keep)
        for c in range(n):
            k = most - 1 - estimate[:, ::-1].argmax(axis=1)
            more[:, c] = estimate[every, k]
            estimate[every, k] = NEVER
            starts[:, c] = start = np.maximum(end - 1 - k, 0)
            more_cuts[:, c] = cuts[:, 0] | np.where(start > 0, np.int64(1) << start, 0)
        if n == 1:
            keep, cuts, at = more, more_cuts, starts
        else:
            columns = [np.concatenate(x, axis=1) for x in ((keep[:, 1:], more), (cuts[:, 1:], more_cuts), (at[:, 1:], starts))]
            first = _first(columns[0], columns[1], n)
            keep, cuts, at = (np.take_along_axis(x, first, axis=1) for x in columns)
        going = (count[row] < n) & (keep[:, 0] > LOST)
        if not going.all():
            row, keep, cuts, at = row[going], keep[going], cuts[going], at[going]
    return found, found_cuts


class _Numbers(dict):
    """Numbers segments in the order they are first met; ``new`` lists those met lately."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self.new.append(segment)
        n = self[segment] = len(self)
        return n


class Segmenter:
    """N-best segmentations of texts; remembers segments."""

    def __init__(self, vocabulary: Pieces, n: int):
        self.vocabulary, self.n = vocabulary, n
        self._forget()

    def _forget(self) -> None:
        """A segment has ``ways`` ways from ``first`` on; ``behind`` is how far the second is behind
        the first, ``sooner`` whether it has the smaller cuts. A way has ids in the pool, a score,
        and ``order``, its place among its segment's ways by cuts."""
        self.known = _Numbers()
        self.size = self.n_ways = self.chars = 0
        self.parts = {c: [np.zeros(0, t)] for c, t in (("pool", np.int32), ("first", np.int64), ("ways", np.int64), ("behind", np.int64), ("sooner", bool), ("begin", np.int64), ("length", np.int64), ("score", np.int64), ("order", np.int64))}

    def _column(self, name: str) -> np.ndarray:
        parts = self.parts[name]
        if len(parts) > 1:
            parts[:] = [np.concatenate(parts)]
        return parts[0]

    def _keep(self, score: np.ndarray, order: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """``score`` and ``order`` by [segment, rank], NEVER where there is no such way; the ways'
        lengths and ids in a row."""
        there = score > NEVER
        ways = there.sum(axis=1)
        second = there[:, 1] if self.n > 1 else np.zeros(len(score), bool)
        behind = np.where(second, score[:, 0] - score[:, min(1, self.n - 1)], -NEVER)
        new = {"pool": ids, "first": self.n_ways + np.cumsum(ways) - ways, "ways": ways, "behind": behind, "sooner": second & (order[:, min(1, self.n - 1)] < order[:, 0]), "begin": self.size + np.cumsum(length) - length, "length": length, "score": score[there], "order": order[there]}
        for name, x in new.items():
            self.parts[name].append(x)
        self.n_ways += int(ways.sum())
        self.size += len(ids)

    def learn(self, segments: list[str]) -> None:
        """Ways of segments that are numbered already, in the order of their numbers."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        self.chars += int(lengths.sum())
        by_length = np.argsort(-lengths, kind="stable")
        falling, lo = lengths[by_length], 0
        ordered = [segments[k] for k in by_length.tolist()]
        while lo < len(ordered):  # a batch is as wide as its longest segment, and none of it is much shorter
            most = int(falling[lo])
            if most > SHORT:
                hi = lo + 1
                self._learn_one(ordered[lo])
            else:
                alike = int(np.searchsorted(-falling, -0.6 * most + 1, side="left"))
                hi = max(lo + 1, min(alike, lo + BATCH, lo + BATCH_CHARS // most))
                self._learn_batch(ordered[lo:hi])
            lo = hi
        for name in ("first", "ways", "behind", "sooner"):
            column = self._column(name)
            mine = column[len(column) - len(segments) :]
            mine[by_length] = mine.copy()

    def _learn_one(self, segment: str) -> None:
        ways = Lattice(self.vocabulary, segment).n_best(self.n)
        score, order = np.full((1, self.n), NEVER, np.int64), np.zeros((1, self.n), np.int64)
        score[0, : len(ways)] = [x for x, _, _ in ways]
        by_cuts = sorted(c for _, c, _ in ways)
        order[0, : len(ways)] = [by_cuts.index(c) for _, c, _ in ways]
        self._keep(score, order, np.array([len(i) for _, _, i in ways]), np.array([i for _, _, x in ways for i in x], np.int32))

    def _learn_batch(self, segments: list[str]) -> None:
        n, rows = np.array(list(map(len, segments))), len(segments)
        width = int(n.max())
        codes = np.zeros((rows, width), np.uint32)
        codes[np.arange(width) < n[:, None]] = _codes("".join(segments))
        edge, edge_ids = self.vocabulary.edges(codes)
        score, cuts = lockstep_n_best(edge, n, self.n)
        order = np.argsort(np.argsort(np.where(score > NEVER, cuts, ALL_CUTS), axis=1, kind="stable"), axis=1, kind="stable")
        row, rank = np.nonzero(score > NEVER)
        begins = (cuts[row, rank][:, None] >> np.arange(width)) & 1 == 1
        begins[:, 0] = True
        way, start = np.nonzero(begins)
        end = np.append(start[1:], 0)
        last = np.append(way[1:] != way[:-1], True)
        end[last] = n[row]
        ids = edge_ids[end - start - 1, start, row[way]]
        length = np.bincount(way, minlength=len(row))
        bare = np.flatnonzero(ids >= self.vocabulary.limit)
        if len(bare):
            spelled = [self.vocabulary.spelled([i]) for i in ids[bare].tolist()]
            times = np.ones(len(ids), np.int64)
            times[bare] = list(map(len, spelled))
            length = np.bincount(way, times, len(row)).astype(np.int64)
            place = np.cumsum(times) - times
            ids = np.repeat(ids, times)
            for k, x in zip(place[bare].tolist(), spelled, strict=True):
                ids[k : k + len(x)] = x
        self._keep(score, order, length, ids.astype(np.int32))

    def segment(self, texts: list[str]) -> Iterator[list[tuple[int, np.ndarray]]]:
        """For each text its N best (score, ids), best first; one without ids for an empty text."""
        if len(self.known) > SEGMENTS or self.size + self.chars > REMEMBERED:
            self._forget()
        prefix = " " if self.vocabulary.dummy_prefix else ""
        cut = [self.vocabulary.cut.findall(prefix + t) if t else [] for t in texts]
        every = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        pool, first, begin, length, score = map(self._column, ("pool", "first", "begin", "length", "score"))
        done = 0
        for segments in cut:
            at = every[done : done + len(segments)]
            done += len(segments)
            way = first[at]
            size = length[way]
            end = np.cumsum(size)
            ids = pool[np.repeat(begin[way] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
            yield self._merged(at, ids, end, int(score[way].sum()))

    def _merged(self, at: np.ndarray, ids: np.ndarray, end: np.ndarray, best: int) -> list[tuple[int, np.ndarray]]:
        """The N best of a text from its segments ``at``, given its best."""
        out = [(best, ids)]
        behind = self._column("behind")[at]
        want = min(self.n - 1, int((behind < -NEVER).sum()))
        if want < 1:
            return out
        level = np.partition(behind, want - 1)[want - 1]
        below, equal = np.flatnonzero(behind < level), np.flatnonzero(behind == level)
        sooner = self._column("sooner")[at[equal]]
        equal = np.concatenate([equal[sooner][::-1], equal[~sooner]])  # those whose change moves a text forward, the last one first
        near = np.sort(np.concatenate([below, equal[: want - len(below)]])).tolist()
        pool, first, many, begin, length, score, order = map(self._column, ("pool", "first", "ways", "begin", "length", "score", "order"))
        ways: list[tuple[int, tuple, tuple]] = [(0, (), ())]  # how far behind, orders from the last segment on, ways
        for p in near:
            w = int(first[at[p]])
            options = [(int(score[w] - score[x]), int(order[x]), x) for x in range(w, w + int(many[at[p]]))]
            ways = sorted((d + e, (o, *key), (*chosen, x)) for d, key, chosen in ways for e, o, x in options)[: self.n]
        for d, _, chosen in ways[1:]:
            parts, done = [], 0
            for p, x in zip(near, chosen, strict=True):
                parts += [ids[done : end[p - 1] if p else 0], pool[begin[x] : begin[x] + length[x]]]
                done = end[p]
            out.append((best - d, np.concatenate([*parts, ids[done:]])))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a segmentation, as bytes."""
        v = self.vocabulary
        size = v.byte_len[ids]
        end = np.cumsum(size)
        text = v.byte_pool[np.repeat(v.byte_at[ids] - (end - size), size) + np.arange(int(size.sum()))].tobytes()
        return text[1:] if v.dummy_prefix and len(ids) else text


def _run(path: str, n: int, text_col: str, emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = in_worker(("pieces", path, n), lambda: Segmenter(Pieces.load(path), n))
        for b in portions(batches, text_col, TEXT_BYTES):
            texts = [t or "" for t in b[text_col].to_pylist()]
            yield emit(b, texts, segmenter)

    return run


def encode(docs: DataFrame, model: str, n: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and segmentations, an array of the up to ``n`` best (score, ids), best first.

    ``model`` is the path of a SentencePiece model file, on every machine. Scores are sums of log
    probabilities in millionths. Of equal scores the segmentation with the longer last piece comes
    first, then with the longer one before it, and so on. A text has fewer than ``n`` only if it can
    be cut in no more ways. Characters without a piece become bytes. A null or empty text has one
    segmentation without ids and score 0. Null ids stay null; repeated rows repeat; an empty table
    gives no rows. Texts of any length are cut whole. Other columns are not read.
    """
    kind = pa.list_(pa.struct([("score", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    def emit(b, texts, segmenter):
        found = [[{"score": s, "ids": ids} for s, ids in x] for x in segmenter.segment(texts)]
        return pa.record_batch({"doc_id": b["doc_id"], "segmentations": pa.array(found, kind)})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(model, n, "text", emit), "doc_id long, segmentations array<struct<score:long,ids:array<int>>>")


def best_ids(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and ids of the best segmentation alone, as encode() defines them."""

    def emit(b, texts, segmenter):
        found = [x[0] for x in segmenter.segment(texts)]
        offsets = np.concatenate([[0], np.cumsum([len(i) for _, i in found])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *(i for _, i in found)])))
        return pa.record_batch({"doc_id": b["doc_id"], "score": pa.array([s for s, _ in found], pa.int64()), "ids": ids})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(model, 1, "text", emit), "doc_id long, score long, ids array<int>")


def digest(docs: DataFrame, model: str, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What encode() gives, without the ids: doc_id, n_tokens and ids_crc32 of the best
    segmentation (ids as little-endian unsigned 32-bit integers), scores and crc32s of the up to
    ``n`` best, and decoded: whether all of them decode to the text."""

    def emit(b, texts, segmenter):
        rows = []
        for t, found in zip(texts, segmenter.segment(texts), strict=True):
            crcs = [crc32(ids.astype("<u4").tobytes()) for _, ids in found]
            raw = t.encode()
            rows.append((len(found[0][1]), crcs[0], [s for s, _ in found], crcs, all(segmenter.decode(ids) == raw for _, ids in found)))
        n_tokens, first, scores, crcs, decoded = (list(x) for x in zip(*rows, strict=True))
        many = pa.list_(pa.int64())
        return pa.record_batch({"doc_id": b["doc_id"], "n_tokens": pa.array(n_tokens, pa.int64()), "ids_crc32": pa.array(first, pa.int64()), "scores": pa.array(scores, many), "crc32s": pa.array(crcs, many), "decoded": pa.array(decoded, pa.bool_())})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(model, n, "text", emit), "doc_id long, n_tokens long, ids_crc32 long, scores array<long>, crc32s array<long>, decoded boolean")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids as ``text_col``; null ids give a null text, bytes that
    are no UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = in_worker(("pieces", model, 1), lambda: Segmenter(Pieces.load(model), 1))
        for b in batches:
            texts = [None if x is None else segmenter.decode(np.array(x, np.int64)).decode(errors="replace") for x in b[ids_col].to_pylist()]
            yield b.append_column(text_col, pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(text_col, StringType())]))
