import hashlib
import random
import re

from llm_helpers import docs_frame
from pyspark.sql import functions as F

from lamina.llm.fill_middle import fill_middle, ranked_bit, restored, token_starts
from lamina.llm.queries import OP11_SQL

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)
TEXTS = ["", None, "a", "ab cd", "Élan vital, 日本語 x\x00y\r\n", "has <P> inside", "tail <S>", "<", "ab<P", "P>cd", "no letters: 123", "x" * 70_000, "word " * 30_000, "🙂🙂a🙂", "\n", "\n\na"]


def by_list(doc_id, text):
    """The rule over a list of tokens."""
    text = text or ""
    w = TOKEN.findall(text)
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, t = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(w), "spm", len(p), len(m), f"<S>{t}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{t}<M>{m}"


def test_against_a_list_of_tokens(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abZ 1<>é日\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "of no id", "x"), (3, "ab cd", "x"), (3, "ab cd", "x")]
    got = fill_middle(docs_frame(spark, rows, ", form string")).withColumn("again", restored(F.col("output"), F.col("form_"))).collect()
    assert len(got) == len(rows)
    want = sorted(map(repr, ((d, *by_list(d, t), t or "") for d, t, _ in rows)))
    assert sorted(repr((r.doc_id, r.n, r.form_, r.prefix_chars, r.middle_chars, r.output, r.again)) for r in got) == want
    assert {r.form_ for r in got} == {"plain", "psm", "spm"} and {r.form for r in got} == {"x"}


def test_sql_on_odd_texts(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    rows = [(i, t) for i, t in enumerate(t for t in TEXTS if t is None or "\x00" not in t)]
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    for r in con.execute(OP11_SQL).fetchall():
        n, form, p, m, out = by_list(r[0], rows[r[0]][1])
        sha = [hashlib.sha256((x or "").encode()).hexdigest() for x in (out, rows[r[0]][1])]
        assert r == (r[0], n, form, p, m, *sha)


def test_masks():
    for t in TEXTS:
        starts = token_starts(t or "")
        places = [m.start() for m in TOKEN.finditer(t or "")]
        assert starts.bit_count() == len(places)
        for k in {0, len(places) // 3, len(places) - 1} & set(range(len(places))):
            assert ranked_bit(starts, len(t), k) == places[k]
        assert ranked_bit(starts, len(t or ""), len(places)) == len(t or "")


def test_empty(spark):
    assert fill_middle(docs_frame(spark, [])).count() == 0
