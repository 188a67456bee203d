import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
from lamina.llm import sentencepiece_nbest  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("aeiounrstl", k=rng.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(30)) for k in range(10)]
    docs, labels = [], []
    for i in range(400):
        text = say(rng.randint(40, 90))
        if i % 5 == 0:
            w = text.split()
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum", "worthless"]))
            text = " ".join(w)
        docs.append([i, text + "\n" + say(8), "en", "s", 1])
        labels.append((i, 0, int(i % 5 == 0)))
    shared = "one line that many documents of this table share"
    for i in (11, 12, 13):
        docs[i][1] += "\n" + shared
    near = docs[21][1].replace("\n", " ").split()
    docs[22][1] = " ".join([*near[:-1], "changed"])
    docs[21][1] = " ".join(near)
    docs[31][1] = say(20) + " " + items[3][1].upper() + " " + say(20)
    docs += [[900, None, None, None, None], [901, "", "en", "s", 0], [None, "no id here", "en", "s", 1], [docs[41][0], docs[41][1], "en", "s", 1]]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), {d[0]: d[1] for d in docs}, shared


def test_stages(spark, folder):
    at, text, shared = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == columns, name
        rows = docs.collect()
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        seen.append({r.doc_id: r.text for r in rows})
    toxic, lines, near, leaks = seen
    clean = {i for i in text if i is None or i % 5 or i >= 400}
    assert clean == toxic.keys()
    assert {900, 901, None} <= leaks.keys()
    assert [shared in (lines[i] or "") for i in (11, 12, 13)] == [True, False, False]
    assert 21 in near and 22 not in near and near.keys() == lines.keys() - {22}
    assert leaks.keys() == near.keys() - {31}


def test_run(spark, folder):
    at, *_ = folder
    rows = corpus_pipeline.run(spark, at).collect()
    assert len(rows) > 300
    v = sentencepiece_nbest.Pieces.load(corpus_pipeline.tokenizer_file("piece_bpe_32k.model"))
    items = {w for r in spark.read.parquet(f"{at}/benchmark.parquet").collect() for w in [r.text.lower()]}
    segmenter = sentencepiece_nbest.Segmenter(v, 1)
    import numpy as np

    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].ids == [] and by_id[i].score == 0 for i in (900, 901))
    texts = [segmenter.decode(np.array(r.ids, np.int64)).decode().lower() for r in rows]
    assert not any(i in t for i in items for t in texts)


def copied(spark, at, to, **changed):
    """The tables of ``at`` in the folder ``to``, some of them changed."""
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{at}/{name}.parquet")
        changed.get(name, lambda x: x)(df).write.parquet(f"{to}/{name}.parquet")
    return str(to)


@pytest.mark.parametrize("empty", [("documents",), ("labels",), ("benchmark",), ("documents", "labels", "benchmark")])
def test_empty_tables(spark, folder, tmp_path, empty):
    """Without labels nobody is toxic, without benchmark nothing leaks, without documents nothing is left."""
    at, text, _ = folder
    out = corpus_pipeline.run(spark, copied(spark, at, tmp_path, **{t: lambda df: df.limit(0) for t in empty}))
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == ["doc_id", "score", "ids"]
    if "documents" in empty:
        assert not ids
    elif "labels" in empty:
        assert {i for i in text if i is not None and i % 5 == 0 and i < 400} <= ids and 31 not in ids
    else:
        assert 31 in ids and 0 not in ids


def test_clashing_columns(spark, folder, tmp_path):
    """Columns that stages make for themselves, held by the documents already, change nothing and stay."""
    from pyspark.sql import functions as F

    at, *_ = folder
    extra = ["score", "predicted", "held_out", "n_lines", "n_dropped", "n_shingles", "component_id", "kept", "ids", "id", "words", "h", "key"]
    to = copied(spark, at, tmp_path, documents=lambda df: df.withColumns({c: F.lit("own") for c in extra}))
    docs = spark.read.parquet(f"{to}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, to)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra], name
    assert {tuple(r) for r in docs.select(*extra).distinct().collect()} == {("own",) * len(extra)}
    plain = sorted(repr(tuple(r)) for r in corpus_pipeline.run(spark, at).collect())
    assert sorted(repr(tuple(r)) for r in corpus_pipeline.run(spark, to).collect()) == plain
