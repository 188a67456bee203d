import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import docs_frame

from lamina.llm import sentencepiece_nbest as sp

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def small():
    """A vocabulary of few pieces, some of equal scores."""
    texts = [" ", "  ", " a", " b", "a", "b", "ab", "ba", "aba", " ab", "abb", "c", "bc", " abc", "bb", "aab"]
    pieces = {t: (i, -[100, 700, 200, 300, 200, 200, 350, 400, 500, 450, 600, 200, 390, 640, 380, 590][i]) for i, t in enumerate(texts)}
    surface = [t.encode() for t in texts] + [bytes([b]) for b in range(256)]
    return sp.Pieces(pieces, list(range(len(texts), len(texts) + 256)), 0, True, surface)


def every(v, text):
    """All segmentations of a text (score, cuts from the last one on, ids), in their order."""
    done = [[] for _ in range(len(text) + 1)]
    done[0] = [(0, (), ())]
    for j in range(1, len(text) + 1):
        for i in range(j):
            piece = text[i:j]
            if piece in v.pieces:
                pid, s = v.pieces[piece]
                done[j] += [(a + s, (i, *c), (*p, pid)) for a, c, p in done[i]]
            elif j - i == 1:
                done[j] += [(a + v.unknown, (i, *c), (*p, *(v.byte_ids[x] for x in piece.encode()))) for a, c, p in done[i]]
    return sorted(done[-1], key=lambda x: (-x[0], x[1]))  # an earlier last cut: a longer last piece


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab c\né"), max_size=11), min_size=1, max_size=5), st.integers(1, 6), st.sampled_from([62, 3]))
def test_against_all_segmentations(texts, n, short):
    """Every rank with its ids, ties included, from batches and from single lattices."""
    v = small()
    kept, sp.SHORT = sp.SHORT, short
    try:
        segmenter = sp.Segmenter(v, n)
        for text, got in zip(texts, segmenter.segment(texts), strict=True):
            want = every(v, " " + text)[:n] if text else [(0, (), ())]
            assert [(s, tuple(i.tolist())) for s, i in got] == [(s, p) for s, _, p in want]
            assert all(segmenter.decode(i) == text.encode() for _, i in got)
    finally:
        sp.SHORT = kept


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=4))
def test_round_trip_with_the_public_model(texts):
    segmenter = sp.Segmenter(sp.Pieces.load(MODEL), 3)
    for text, got in zip(texts, segmenter.segment(texts), strict=True):
        assert all(segmenter.decode(ids) == text.encode() for _, ids in got)
        assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


def ways(segmenter, segment):
    k = segmenter.known[segment]
    first, n = segmenter._column("first")[k], segmenter._column("ways")[k]
    begin, length, score, pool = (segmenter._column(c) for c in ("begin", "length", "score", "pool"))
    return [(score[w], pool[begin[w] : begin[w] + length[w]].tolist()) for w in range(first, first + n)]


def test_batches_agree_with_single_lattices():
    rng = random.Random(0)
    v = sp.Pieces.load(MODEL)
    words = sorted({" " * rng.randint(0, 2) + "".join(rng.choices("etaoinsrhlé中1.", k=rng.randint(1, 60))) for _ in range(400)})
    for n in (1, 3):
        segmenter = sp.Segmenter(v, n)
        segmenter.learn([w for w in words if segmenter.known[w] >= 0])
        for w in words:
            assert ways(segmenter, w) == [(s, ids) for s, _, ids in sp.Lattice(v, w).n_best(n)]


def test_frames(spark):
    rows = [(1, "Hello  world\nagain ▁x"), (2, None), (3, ""), (4, "x" * 20_000), (5, "word " * 20_000), (None, "a"), (1, "Hello  world\nagain ▁x")]
    frame = docs_frame(spark, [(*r, [1]) for r in rows], ", ids array<int>")
    got = sp.encode(frame, MODEL, 3).collect()
    assert len(got) == len(rows)
    out = {r.doc_id: r for r in sp.digest(frame, MODEL, 3).collect()}
    for r in got:
        d = out[r.doc_id]
        assert d.decoded and d.n_tokens == len(r.segmentations[0].ids) and d.scores == [s.score for s in r.segmentations]
    assert out[2].n_tokens == 0 and out[3].scores == [0]
    best = sp.best_ids(frame, MODEL)
    assert sorted((r.doc_id or 0, r.text) for r in sp.decode(best, MODEL).collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert sp.digest(docs_frame(spark, []), MODEL).count() == 0


def test_ties_fall_alike_in_batches_and_lattices():
    v, rng = small(), random.Random(8)
    words = sorted({"".join(rng.choices("abcé ", [6, 6, 3, 1, 1], k=rng.randint(1, 62))) for _ in range(400)})
    for n in (1, 3):
        segmenter = sp.Segmenter(v, n)
        segmenter.learn([w for w in words if segmenter.known[w] >= 0])
        for w in words:
            assert ways(segmenter, w) == [(s, ids) for s, _, ids in sp.Lattice(v, w).n_best(n)]


def test_long_segments_across_blocks(monkeypatch):
    """The same ways whatever the blocks, and those of all segmentations of short ones."""
    v, rng = small(), random.Random(4)
    for _ in range(60):
        text = "".join(rng.choices("abcé ", [6, 6, 3, 1, 1], k=rng.randint(1, 12)))
        want = every(v, text)
        for block in (1, 3, 4096):
            monkeypatch.setattr(sp, "BLOCK", block)
            for n in (1, 4, 30):
                got = sp.Lattice(v, text).n_best(n)
                assert [(s, tuple(p)) for s, _, p in got] == [(s, p) for s, _, p in want[:n]]
                assert [c for _, c, _ in sorted(got, key=lambda x: x[1])] == sorted(c for _, c, _ in got)


MANY = """
import random, resource
from lamina.llm import sentencepiece_nbest as sp
v = sp.Pieces.load({model!r})
rng = random.Random(1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for ways, text in ((2, "x" * 200_000), (1, "".join(rng.choices("etaoinsrhlé中1.", k=1_000_000)))):
    segmenter = sp.Segmenter(v, ways)
    found = next(iter(segmenter.segment([text])))
    assert len(found) == ways and all(segmenter.decode(ids) == text.encode() for _, ids in found)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


def test_memory_of_a_million_characters_without_a_space():
    """MB beyond the vocabulary's."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).parents[2])
    out = subprocess.run([sys.executable, "-c", MANY.format(model=MODEL)], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": os.pathsep.join([root, *sys.path])}, check=True)
    assert int(out.stdout) < 700, out.stdout


def test_very_long_segment():
    v = small()
    text = "ab" * 700
    (s, ids), *_ = next(iter(sp.Segmenter(v, 2).segment([text])))
    assert sp.Segmenter(v, 1).decode(ids) == text.encode() and s == sp.Lattice(v, " " + text).best[-1]
