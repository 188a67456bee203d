from lamina.llm.components import connected_components
from lamina.llm.queries import OP8_SQL, URL_RULES
from lamina.llm.url_filter import judge_urls, resolved


def judge(spark, rows, redirects=None):
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string")
    if redirects is not None:
        redirects = spark.createDataFrame(redirects, "from_url string, to_url string")
    return {r.page_id: r for r in judge_urls(pages, URL_RULES, redirects=redirects).collect()}


def test_rules(spark):
    got = judge(spark, [(1, "http://A.example.COM/en/1?x", None), (2, "https://www.example.com/en/1", ""), (3, "http://b.net/es/#f", "<p>"), (4, "http://example.com", None), (5, None, None), (6, "no scheme.com/", None), (7, "http://xexample.com/en/", None), (8, "ftp://h.net/x://y.com/es/", None), (9, "http://c.com?u=http://b.net/es/", None), (10, "http://q.net/ES/", None), (11, "://net/fr/a/b#c", None)])
    assert {k: (r.host, r.path, r.rule, r.verdict_) for k, r in got.items()} == {
        1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 3: ("b.net", "/es/", "net/es/", "block"),
        4: ("example.com", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("xexample.com", "/en/", "com/", "allow"), 8: ("h.net", "/x://y.com/es/", None, "allow"),
        9: ("c.com", "", None, "allow"), 10: ("q.net", "/ES/", None, "allow"), 11: ("net", "/fr/a/b", "net/fr/", "block"),
    }


def test_aliases(spark):
    rows = [
        (1, "http://a.org/1", '<head><LINK href="http://b.org/2" rel="canonical"></head>'),
        (2, "http://b.org/2#x", '<meta content="0; URL=/3?a=1&amp;b=2" http-equiv=refresh>'),
        (3, "http://b.org/3?a=1&b=2", "<meta http-equiv='refresh' content='5;url=//x.net/es/y'>"),
        (4, "http://c.com/4", "<link rel='canonical' href='http://a.org/1'>"),
        (5, "http://d.org/f/5", "<link rel=canonical href=6>"),
        (6, "http://d.org/f/6", "<link rel='stylesheet' href='http://x.net/es/y'>"),
        (7, "http://e.org/7", None),
        (8, "http://f.org/8", '<link rel="canonical" href="#top"><link rel="canonical" href="">'),
    ]
    got = judge(spark, rows, [("http://e.org/7", "http://d.org/f/6"), (None, "http://x.net/es/y"), ("http://q.org/", None)])
    assert {k: r.verdict_ for k, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow"}
    got = judge(spark, rows, [("http://e.org/7", "http://d.org/f/6"), ("http://e.org/7", "http://z.net/fr/")])
    assert {k for k, r in got.items() if r.verdict_ == "block"} == {1, 2, 3, 5, 6, 7}


ODD = [
    (1, "http://a.org/1", '<head><LINK href="http://b.org/2" rel="canonical"></head>'),
    (2, "http://b.org/2#x", '<meta content="0; URL=/3?a=1&amp;b=2" http-equiv=refresh>'),
    (3, "http://b.org/3?a=1&b=2", "<meta http-equiv='refresh' content='5;url=//x.net/es/y'>"),
    (4, "http://c.com/4", "<link rel='canonical' href='http://a.org/1'>"),
    (5, "http://d.org/f/5", "<link rel=canonical href=6>"),
    (6, "http://d.org/f/6", "<link rel='stylesheet' href='http://x.net/es/y'>"),
    (7, "http://e.org/7", None),
    (8, "http://f.org/8", '<link rel="canonical" href="#top"><link rel="canonical" href="">'),
    (9, "http://g.org/a/b", "<link  rel = canonical  href = '?q=1' ><linked rel=canonical href='http://x.net/es/'>"),
    (10, "http://g.org/a/b?q=1", "<META HTTP-EQUIV=\"Refresh\" CONTENT=\"1; url=http://x.net/fr/z\">"),
    (11, None, "<link rel=canonical href=http://x.net/es/>"),
    (12, "no scheme", "<link rel=canonical href=http://x.net/es/>"),
    (13, "http://h.org/13", "<p>" + "long " * 50_000 + "<link rel=canonical href=http://a.org/1>"),
    (13, "http://h.org/13", "<p>" + "long " * 50_000 + "<link rel=canonical href=http://a.org/1>"),
    (14, "http://example.com/en/1", "<link rel=canonical href=http://www.example.com/en/1>"),
]


def test_against_sql_with_patterns_of_its_own(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame(ODD, columns=["page_id", "url", "html"]))
    want = con.execute(OP8_SQL).fetchall()
    got = judge_urls(spark.createDataFrame(ODD, "page_id long, url string, html string"), URL_RULES)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select("page_id", "host", "path", "rule", "verdict").collect())
    assert {r[0] for r in want if r[4] == "block"} == {1, 2, 3, 9, 10, 13, 14}


HARD = {  # html, whether the page links to the blocked one, written from the rules of HTML and URLs
    "plain": ('<link rel="canonical" href="http://a.example.com/en/x">', True),
    "one word of several": ('<link rel="shortlink CANONICAL" href="http://a.example.com/en/x">', True),
    "an attribute before": ('<link data-href="/y" rel=canonical href=http://a.example.com/en/x>', True),
    "a sign in a value": ('<link title="a>b" rel=\'canonical\' href="http://a.example.com/en/x"/>', True),
    "another word": ('<link rel="canonicalized-not" href="http://a.example.com/en/x">', False),
    "in a comment": ('<!-- <link rel="canonical" href="http://a.example.com/en/x"> -->', False),
    "in a script": ('<script>"<link rel=canonical href=http://a.example.com/en/x>"</script>', False),
    "in a title": ("<title><link rel=canonical href=http://a.example.com/en/x></title>", False),
    "in a template": ("<template><link rel=canonical href=http://a.example.com/en/x></template>", False),
    "in a value": ("<p title='<link rel=canonical href=http://a.example.com/en/x>'>", False),
    "the default port": ('<link rel="canonical" href="http://A.example.com:80/en/x#top">', True),
    "another port": ('<link rel="canonical" href="http://a.example.com:8080/fr/x">', False),
    "a base": ('<base href="http://a.example.com/en/"><link rel="canonical" href="x">', True),
    "a base behind": ('<link rel="canonical" href="./x"><base href="//a.example.com/en/y?z"><base href="/">', True),
    "steps up": ('<link rel="canonical" href="http://a.example.com/fr/../en/./x">', True),
    "references": ("<link rel=&#99;anonical href=http&colon;//a.example.com/en/x>", True),
    "spaces around": ('<link rel="canonical" href=" \nhttp://a.example.com/en/x ">', True),
    "first of two": ('<link rel="canonical" href="http://z.org/" href="http://a.example.com/en/x">', False),
    "an end tag": ("</link rel=canonical href=http://a.example.com/en/x>", False),
    "a refresh": ('<meta http-equiv="refresh" content="0;url=\'http://a.example.com/en/x\' y">', True),
    "a refresh without its name": ('<META content="3, http://a.example.com/en/x" HTTP-EQUIV=" REFRESH ">', True),
    "no refresh": ('<meta name="refresh" content="0;url=http://a.example.com/en/x">', False),
    "a refresh without a time": ('<meta http-equiv="refresh" content="url=http://a.example.com/en/x">', False),
    "another scheme": ('<link rel="canonical" href="mailto:a.example.com/en/x">', False),
    "a query with names of references": ("<link rel=canonical href=http://a.example.com/en/x?a=1&copy=2>", True),
}


def test_links_as_html_has_them(spark):
    rows = [(k, f"http://p{k}.org/a/b", html) for k, (html, _) in enumerate(HARD.values())]
    rows += [(90, "http://q.org/1", '<link rel=canonical href="https://r.org/?a=1&copy=2">'), (91, "https://r.org:443/?a=1&copy=2", "<link rel=canonical href=//a.example.com/en/x>")]
    got = judge(spark, rows)
    names = list(HARD)
    for k, (_, linked) in enumerate(HARD.values()):
        assert got[k].verdict_ == ("block" if linked else "allow"), names[k]
    assert got[90].verdict_ == got[91].verdict_ == "block" and got[91].host == "r.org:443"


def test_resolving():
    """Against the standard library, where that follows the same rules."""
    from urllib.parse import urljoin, urlsplit

    for page in ("http://h.org/a/b/c?d", "http://h.org/", "http://h.org/a"):
        for t in ("x", "./x", "../x", "../../x/.", "/x/../y", "?q", "//k.org/z?w", "https://k.org/b", "x/..", "..", ".", "x?y=/../z", "http:y"):
            want = urlsplit(urljoin(page, t))
            host, path = want.netloc, want.path + ("?" + want.query if want.query else "")
            got = resolved(t, "http", urlsplit(page).netloc, urlsplit(page).path)
            assert got[1:] == (host, path), (page, t)


def test_empty(spark):
    assert judge(spark, []) == {}


def test_components(spark):
    import random

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5000, i) for i in range(1000, 1200)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)] + [(7, 7), (8, None), (100, 101)]
    parent = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and (x := find(a)) != (y := find(b)):
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
