import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import docs_frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lamina.llm import simple8b, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 40))
def test_round_trip(values, times):
    v = np.array(values * times, np.uint64)
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words) == v).all()
    assert len(offsets) == -(-len(v) // simple8b.BLOCK)
    for k, lo in enumerate(offsets):
        hi = offsets[k + 1] if k + 1 < len(offsets) else len(words)
        assert (simple8b.decode(words[lo:hi]) == v[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=6))
def test_chunks_give_the_ids_of_whole_texts(texts):
    encoder = token_files.Encoder(PATH)
    assert encoder.by_chunk
    ids, counts = encoder.ids([t.encode() for t in texts])
    want = [WORDS.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZéÉßΣσİıſK'’.,-<|>1٣ \u0301\u0130ǅﬁ中\n"), max_size=9), max_size=4))
def test_odd_words_give_the_ids_of_whole_texts(texts):
    ids, _ = token_files.Encoder(PATH).ids([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in WORDS.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers(name):
    path = public_tokenizers.path(name)
    texts = ["It's  a\ttest\n\nof ΑΣ Σ words <|endoftext|> é   x", "", " "]
    ids, counts = token_files.Encoder(path).ids([t.encode() for t in texts])
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == list(map(len, want))


def test_files(spark, tmp_path):
    rows = [(-(2**63), "least"), (7, "b a"), (3, None), (5, ""), (-2, "word " * 30_000), (9, "x"), (9, "y"), (None, "none"), (4, "same"), (4, "same")]
    manifest, folder = token_files.write_token_files(docs_frame(spark, [(*r, 1) for r in rows], ", ids_crc32 int"), PATH, 2, str(tmp_path))
    got = sorted(map(tuple, token_files.read_token_files(manifest, folder).collect()), key=lambda r: r[1])
    first = lambda i: (i is not None, i or 0)
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=first) and got[0][0] is None and got[1][0] == -(2**63)
    got = [(-(2**64) if r[0] is None else r[0], *r[1:]) for r in got]
    want = sorted((i if i is not None else -(2**64), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows for ids in [[*WORDS.encode(t or "", add_special_tokens=False).ids, 2]])
    assert sorted((r[0], r[2], r[3]) for r in got) == want
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    docs = {}
    for m in manifest.collect():
        ids, values = token_files.decode_file(m["path"])
        docs |= dict(zip(ids.tolist(), values, strict=True))
    assert docs[7].tolist() == [*WORDS.encode("b a", add_special_tokens=False).ids, 2]


def test_empty(spark):
    manifest, folder = token_files.write_token_files(docs_frame(spark, []), PATH, 2)
    assert token_files.read_token_files(manifest, folder).collect() == []
