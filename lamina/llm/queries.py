"""The queries of this subpackage, over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import (
    decontamination,
    fill_middle,
    html_text,
    line_dedup,
    near_dedup,
    periodic_runs,
    secret_scan,
    sentencepiece_nbest,
    sharding,
    token_files,
    topk_search,
    toxicity,
    url_filter,
)
from lamina.llm.common import with_columns
from lamina.tables import table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    vectors = table(spark, sf_dir, "embeddings").where(sound).select("vec_id", topk_search.quantised(F.col("embedding")).alias("vector"))
    return topk_search.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
keys AS (SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT l.doc_id, l.i, l.line, k.key IS NOT NULL AND l.doc_id <> k.keeper AS dropped FROM lines l LEFT JOIN keys k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, shingle_words=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] ELSE w END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (
  SELECT a, b FROM (SELECT a, b FROM links UNION SELECT b, a FROM links)
  UNION
  SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id
"""


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_AFTER = "CASE WHEN contains({u}, '://') THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
# Stated apart from the operator: none of its patterns is used here.
OP8_SQL = rf"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS r(action, h, p)),
parsed AS (
  SELECT page_id, html, contains(url, '://') AS sound, {_LOWER.format("regexp_extract(coalesce(tail, ''), '^[^/?#]*')")} AS host,
    regexp_extract(coalesce(tail, ''), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(tail, ''), '^[^/?#]*([^#]*)', 1) AS more
  FROM (SELECT *, {_AFTER.format(u="url")} AS tail FROM pages)),
nodes AS (SELECT *, CASE WHEN sound THEN host || more END AS node FROM parsed),
tags AS (
  SELECT node, host, path, tag, replace(replace(regexp_replace(lower(tag), '[ \t\n\r\f\v]*=[ \t\n\r\f\v]*', '=', 'g'), '"', ''), chr(39), '') AS small FROM (
    SELECT node, host, path, unnest(regexp_extract_all(coalesce(html, ''), '<[A-Za-z]+[ \t\n\r\f\v][^>]*>')) AS tag FROM nodes WHERE node IS NOT NULL)),
hrefs AS (
  SELECT *, regexp_extract(tag, '[hH][rR][eE][fF][ \t\n\r\f\v]*=[ \t\n\r\f\v]*("[^"]*"|\x27[^\x27]*\x27|[^ \t\n\r\f\v"\x27>]+)', 1) AS h FROM tags
  WHERE regexp_matches(small, '^<link[ \t\n\r\f\v]') AND contains(small, 'rel=canonical')),
targets AS (
  SELECT node, host, path, trim(replace(CASE WHEN h[1] IN ('"', chr(39)) THEN substr(h, 2, length(h) - 2) ELSE h END, '&amp;', '&')) AS t FROM hrefs
  UNION ALL
  SELECT node, host, path, trim(replace(regexp_extract(tag, '[uU][rR][lL][ \t\n\r\f\v]*=[ \t\n\r\f\v]*["\x27]?([^ \t\n\r\f\v"\x27>]+)', 1), '&amp;', '&')) FROM tags
  WHERE regexp_matches(small, '^<meta[ \t\n\r\f\v]') AND contains(small, 'http-equiv=refresh')),
urls AS (
  SELECT node, CASE WHEN strpos(t, '://') > 1 AND regexp_full_match(substr(t, 1, strpos(t, '://') - 1), '[a-zA-Z][-+.a-zA-Z0-9]*') THEN t WHEN t[1:2] = '//' THEN 'http:' || t
    WHEN t[1] = '/' THEN 'http://' || host || t WHEN t[1] = '?' THEN 'http://' || host || path || t
    WHEN contains(path, '/') THEN 'http://' || host || substr(path, 1, length(path) - strpos(reverse(path), '/') + 1) || t ELSE 'http://' || host || '/' || t END AS u
  FROM targets WHERE t <> '' AND t[1] <> '#'),
edges AS (SELECT node AS a, {_LOWER.format("regexp_extract(tail, '^[^/?#]*')")} || regexp_extract(tail, '^[^/?#]*([^#]*)', 1) AS b FROM (SELECT node, {_AFTER.format(u="u")} AS tail FROM urls)),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
fits AS (
  SELECT n.node, n.host, n.path, r.action, r.h || r.p AS rule, row_number() OVER (PARTITION BY n.node, n.host, n.path ORDER BY length(r.h || r.p) DESC) AS k
  FROM (SELECT DISTINCT node, host, path FROM nodes UNION SELECT DISTINCT b, regexp_extract(b, '^[^/?#]*'), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) FROM edges) n
  JOIN rules r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p)),
bad AS (SELECT DISTINCT r.a AS node FROM reach r JOIN fits f ON f.node = r.b AND f.k = 1 AND f.action = 'block')
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.action, CASE WHEN b.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM nodes n LEFT JOIN fits f ON f.k = 1 AND f.node IS NOT DISTINCT FROM n.node AND f.host = n.host AND f.path = n.path LEFT JOIN bad b ON b.node = n.node
"""


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(manifest, folder)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.digest(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), n=3)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), again)


# Written from the rule: tokens as a list, no masks.
OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (
  SELECT doc_id, text, w, len(w) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM t),
cut AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(w[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p, array_to_string(w[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(w[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM cut
"""


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


# No density here: the given pages mark the article by its element, and these are the tags inside.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
blocks AS (SELECT page_id, url, regexp_split_to_array(body, '</?(?:h1|p)>') AS parts FROM a),
plain AS (
  SELECT page_id, url, [trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ 	

]+', ' ', 'g')) FOR x IN parts] AS lines
  FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, array_to_string([x FOR x IN lines IF x <> ''], chr(10)) AS text FROM plain)
"""


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in every tenth document, by its id's crc32, the words from one on repeat."""

    def repeat(h: int, text: str) -> str:
        words = periodic_runs.words_of(text)
        n, g = len(words), h // 10
        if not n:
            return text
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode("utf-8", "surrogatepass")

    def make(texts: list[str]):
        # a crc32, a line feed, the text
        cut = (t.partition("\n") for t in texts)
        return ([repeat(int(h), t) if h.endswith("0") else t for h, _, t in cut],)

    h = F.coalesce(F.crc32(F.col("doc_id").cast("string")).cast("string"), F.lit(""))
    joined = docs.select("doc_id", F.concat(h, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return with_columns(joined, {"text": "string"}, make, "text").select("doc_id", F.col("text_").alias("text"))


# A crc32 by its table, made from the polynomial; and runs from pairs of equal words, not from shifts.
OP13_SQL = r"""
WITH crc AS MATERIALIZED (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295, list_reduce(list_concat([4294967295], [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM documents CROSS JOIN crc),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a, 3 + h // 10 % 8 AS m FROM d),
p AS MATERIALIZED (SELECT doc_id, n, CASE WHEN hit THEN [w[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // m) ELSE i END + 1] FOR i IN range(n)] ELSE w END AS w FROM g),
x AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM p),
e AS (SELECT u.doc_id, u.i, v.i - u.i AS q FROM x u JOIN x v ON u.doc_id = v.doc_id AND u.word = v.word AND v.i > u.i AND v.i - u.i <= u.n // 2),
s AS (SELECT doc_id, q, min(i) AS start, count(*) AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
r AS MATERIALIZED (SELECT doc_id, start, k + q AS length, min(q) AS period FROM s WHERE k + q >= greatest(12, 2 * q) GROUP BY ALL),
f AS (SELECT doc_id, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'p': period}, {'l': -length, 's': start, 'p': period}) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
c AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY x.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(planted(table(spark, sf_dir, "documents")), min_length=12, min_exponent=2)
    best = F.expr("array_min(transform(runs, r -> named_struct('less', -r.length, 'start', r.start, 'period', r.period)))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    out = out.withColumn("best", best).withColumn("length", -F.col("best.less"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), "length", F.col("best.period").alias("period"),
        F.expr("1000 * length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )  # fmt: skip


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op11_fill_middle": op11_fill_middle,
    "op12_html_text": op12_html_text,
    "op13_periodic_runs": op13_periodic_runs,
    "op7_secret_scan": op7_secret_scan,
    "op10_sentencepiece": op10_sentencepiece,
    "op8_url_filter": op8_url_filter,
    "op1_topk_search": op1_topk_search,
    "op3_toxicity": op3_toxicity,
    "op6_decontamination": op6_decontamination,
    "op4_near_dedup": op4_near_dedup,
    "op9_token_files": op9_token_files,
    "op5_minimax_sharding": op5_minimax_sharding,
    "op2_line_dedup": op2_line_dedup,
}
ORACLE_SQL = {
    "op11_fill_middle": OP11_SQL,
    "op12_html_text": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
    "op8_url_filter": OP8_SQL,
    "op1_topk_search": OP1_SQL,
    "op4_near_dedup": OP4_SQL,
    "op2_line_dedup": OP2_SQL,
}
