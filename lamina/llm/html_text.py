"""The main text of web pages, by composite text density.

A page is read into a tree. Parts that say by element, role, class or heading what they are (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, reader comments) are cut off. For
every node that is left, its density is the number of its characters for each tag, adjusted by how
many of both lie in links. The node whose children's densities have the largest sum leads to the
article; the smallest density on its path to the body is the threshold for other parts.
"""

from __future__ import annotations

import html
import html.entities
import re
from math import e, log

from pyspark.sql import DataFrame

from lamina.llm.common import with_columns

# Names of elements as the HTML standard groups them.
VOID = frozenset("area base basefont bgsound br col command embed frame hr img input keygen link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul".split())
#: Open elements beyond which implied ends don't reach.
SCOPE = frozenset("applet body button caption html marquee object table td template th".split())
TABLE_SCOPE = frozenset("html table template".split())
TABLE_PARTS = frozenset("caption table tbody td tfoot th thead tr".split())
BLOCKS = ENDS_P | frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What doesn't end the head.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: What an element's start tag ends, and what stops the search for it.
IMPLIED = {
    "li": (frozenset(["li"]), SCOPE | {"ul", "ol", "menu", "dir"}),
    "dd": (frozenset(["dd", "dt"]), SCOPE | {"dl"}),
    "dt": (frozenset(["dd", "dt"]), SCOPE | {"dl"}),
    "option": (frozenset(["option"]), SCOPE | {"select", "datalist"}),
    "optgroup": (frozenset(["option", "optgroup"]), SCOPE | {"select"}),
    "tr": (frozenset(["tr", "td", "th"]), TABLE_SCOPE),
    "td": (frozenset(["td", "th"]), TABLE_SCOPE | {"tr"}),
    "th": (frozenset(["td", "th"]), TABLE_SCOPE | {"tr"}),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), TABLE_SCOPE),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), TABLE_SCOPE),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), TABLE_SCOPE),
}
# What is no article.
#: Elements that never hold text of the article.
NEVER = frozenset("aside audio button canvas datalist dialog embed footer head iframe input menu meter nav noembed noframes noscript object option progress script search select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
#: Words of a class or id; an element with one of them goes, unless it holds the article.
NAMED = frozenset(
    """ad ads adbox adslot adsense adv advert adverts advertisement advertisements advertising alert banner breadcrumb breadcrumbs
    comment comments commentlist consent cookie cookies copyright cta disclaimer disqus dropdown footer footnav gdpr guestbook
    hamburger login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination
    paywall popup privacy promo promos promoted promotion recommendations recommended register related replies reply respond search share
    sharing sidebar sidebars signin signup skip social sponsor sponsored sponsors subscribe subscription taboola tagcloud teaser teasers
    toast toolbar topbar trending widget widgets""".split()
)
#: Words of the class of a block that heads an article and not the site.
OF_ARTICLE = frozenset("article content entry post story".split())
#: Headings, lower-cased and without digits and marks, of what readers wrote.
COMMENT_HEADINGS = frozenset(["comment", "comments", "reader comments", "user comments", "leave a comment", "leave a reply", "responses", "kommentar", "kommentare", "leserkommentare", "commentaire", "commentaires", "laisser un commentaire", "comentario", "comentarios", "deja un comentario"])

_TAG = re.compile(r"</?([A-Za-z][^\x00\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)?))?")
_TAG_END = re.compile(r"[\s/]*>?")
_COMMENT_END = re.compile(r"--!?>")
#: In attributes a name without a semicolon before = or a letter is no reference.
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![A-Za-z0-9=])))")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSERS = {t: re.compile(rf"(?i)</{t}(?=[\s/>])") for t in RAW}
_HIDDEN = re.compile(r"(?i)(?:display\s*:\s*none|visibility\s*:\s*hidden)")
_NO_WORDS = re.compile(r"[^a-zA-Z ]+")


def _referred(m: re.Match) -> str:
    return html.unescape(m[0]) if m[0][1] == "#" else html.entities.html5.get(m[0][1:], m[0])


def pieces(page: str):
    """('text', decoded), ('start', name, attributes) and ('end', name) in page order, without
    comments. What is not closed reaches to the page's end."""
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            yield "text", html.unescape(page[at:lt])
        if lt >= end:
            return
        m = _TAG.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                if page.startswith((">", "->"), lt + 4):
                    at = page.index(">", lt) + 1
                else:
                    m = _COMMENT_END.search(page, lt + 4)
                    at = m.end() if m else end
            elif page.startswith(("<!", "<?", "</"), lt) and lt + 2 < end:
                at = page.find(">", lt) + 1 or end
            else:
                yield "text", "<"
                at = lt + 1
            continue
        name, at = m[1].lower(), m.end()
        attributes = None
        if page[at : at + 1] != ">":
            attributes = {}
            while (a := _ATTRIBUTE.match(page, at)) is not None:
                value = next((v for v in a.groups()[1:] if v is not None), "")
                attributes.setdefault(a[1].lower(), _REFERENCE.sub(_referred, value) if "&" in value else value)
                at = a.end()
            at = _TAG_END.match(page, at).end()
            if page[at - 1] != ">":
                return  # the page ends inside a tag, which then is none
        else:
            at += 1
        if page[lt + 1] == "/":
            yield "end", name
            continue
        yield "start", name, attributes
        if name in RAW:
            m = _CLOSERS[name].search(page, at)
            stop = m.start() if m else end
            if stop > at:
                yield "text", page[at:stop]
            at = stop


class Page:
    """Nodes by number, parents before children: names, attributes, parents; and in page order
    events: (node, its text) or (node that starts, None)."""

    def __init__(self, page: str):
        self.names, self.attributes, self.parents = ["html"], [None], [-1]
        self.events: list[tuple[int, str | None]] = []
        self.open = [0]
        self.counts = {"html": 1}
        for piece in pieces(page):
            if piece[0] == "text":
                if len(self.open) < 3 and piece[1].strip():
                    self._body(None)
                self.events.append((self.open[-1], piece[1]))
            elif piece[0] == "start":
                self._start(piece[1], piece[2])
            else:
                self._end(piece[1])
        del self.open, self.counts

    def _body(self, name: str | None) -> None:
        """End the head and start the body, unless ``name`` belongs to the head."""
        if name in IN_HEAD or name in ("html", "head") or len(self.open) > 1 and self.names[self.open[1]] != "head":
            return
        if len(self.open) > 1 and self.names[self.open[-1]] == "head":
            self._pop(1)
        if len(self.open) == 1 and name not in ("body", "frameset"):
            self._start("body", None)

    def _start(self, name: str, attributes: dict | None) -> None:
        self._body(name)
        if name in ("html", "head", "body") and name in self.counts:
            return
        if name in ENDS_P and self.counts.get("p"):
            self._close(frozenset(["p"]), SCOPE)
        if name in HEADINGS and self.names[self.open[-1]] in HEADINGS:
            self._pop(len(self.open) - 1)
        if name in IMPLIED:
            self._close(*IMPLIED[name])
        node = len(self.names)
        self.names.append(name)
        self.attributes.append(attributes)
        self.parents.append(self.open[-1])
        self.events.append((node, None))
        if name not in VOID:
            self.open.append(node)
            self.counts[name] = self.counts.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if name in ("html", "body") or not self.counts.get(name):
            if name == "br":
                self._start("br", None)
            return
        # an end tag of a line's part reaches no further than its block
        stops = BLOCKS if name not in BLOCKS else (TABLE_SCOPE if name in TABLE_PARTS else SCOPE) - {name}
        self._close(HEADINGS if name in HEADINGS else frozenset([name]), stops)

    def _close(self, names: frozenset, stops: frozenset) -> None:
        """Pop up to the outermost open one of ``names`` that stands before one of ``stops``."""
        k, found = len(self.open) - 1, 0
        while k > 0:
            name = self.names[self.open[k]]
            if name in names:
                found = k
                if len(names) == 1:
                    break
            elif name in stops:
                break
            k -= 1
        if found:
            self._pop(found)

    def _pop(self, k: int) -> None:
        for node in self.open[k:]:
            self.counts[self.names[node]] -= 1
        del self.open[k:]


def _words(attributes: dict | None) -> set[str]:
    return {w.lower() for a in ("class", "id") if a in attributes for w in _WORDS.findall(attributes[a])} if attributes else set()


def _hidden(attributes: dict) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(attributes.get("style", "")))


def kept_nodes(page: Page) -> list[bool]:
    """Which nodes are left when all that says it is no part of an article goes, with all in it.

    A form, or an element with one of the names, is spared where it holds an article or main, or an h1
    and three paragraphs: then it wraps the page. A header stays if it heads an article.
    """
    names, parents = page.names, page.parents
    n = len(names)
    words = [_words(a) for a in page.attributes]
    named = [not words[v].isdisjoint(NAMED) or (page.attributes[v] or {}).get("role", "").lower() in ROLES for v in range(n)]
    holds, titles, heads, paragraphs = [False] * n, [False] * n, [False] * n, [0] * n
    for v in range(n - 1, 0, -1):
        name, up = names[v], parents[v]
        if name in NEVER:
            continue
        holds[v] |= titles[v] and paragraphs[v] > 2
        holds[up] |= holds[v] or name == "main" or name == "article" and not named[v]
        titles[up] |= titles[v] or name == "h1"
        heads[up] |= heads[v] or name in HEADINGS
        paragraphs[up] += paragraphs[v] + (name == "p")
    keep, inside = [True] * n, [False] * n
    for v in range(1, n):
        name, up = names[v], parents[v]
        inside[v] = inside[up] or name in ("article", "main")
        keep[v] = keep[up] and name not in NEVER and not (page.attributes[v] and _hidden(page.attributes[v]))
        if named[v] and name not in HEADINGS and name not in ("body", "main") or name == "form":
            keep[v] &= holds[v]
        if name == "header" or name == "div" and "header" in words[v]:
            keep[v] &= heads[v] and (inside[up] or not words[v].isdisjoint(OF_ARTICLE))
    said: dict[int, str] = {}
    for v, t in page.events:
        if t is not None and names[v] in HEADINGS and keep[v]:
            said[v] = said.get(v, "") + t
    for v, t in said.items():
        if " ".join(_NO_WORDS.sub(" ", t).lower().split()) in COMMENT_HEADINGS:
            for w in range(v, n):
                keep[w] &= parents[w] != parents[v]
    for v in range(1, n):
        keep[v] &= keep[parents[v]]
    return keep


class Densities:
    """For every kept node: its density, the sum of its children's, and the best node below."""

    def __init__(self, page: Page, keep: list[bool]):
        n, names, parents = len(page.names), page.names, page.parents
        chars, linked = [0] * n, [0] * n
        tags, link_tags = [0] * n, [0] * n
        self.block = block = [v for v in range(n) if keep[v] and names[v] in BLOCKS]
        blocks = set(block)
        in_link = [False] * n
        home = list(range(n))  # the innermost block at or above a node
        for v in range(1, n):
            in_link[v] = in_link[parents[v]] or names[v] == "a"
            if v not in blocks:
                home[v] = home[parents[v]]
        own = [0] * n
        for v, t in page.events:
            if t is not None and keep[v]:
                k = sum(map(len, t.split()))
                chars[v] += k
                own[home[v]] += k
                if in_link[v]:
                    linked[v] += k
        for v in range(n - 1, 0, -1):
            up = parents[v]
            if keep[v]:
                chars[up] += chars[v]
                linked[up] += linked[v]
                tags[up] += tags[v] + (names[v] not in VOID)
                link_tags[up] += link_tags[v] + (names[v] == "a")
        self.body = next((v for v in range(n) if names[v] == "body" and keep[v]), 0)
        share = linked[self.body] / max(1, chars[self.body])
        self.density, self.sums = density, sums = [0.0] * n, [0.0] * n
        for v in block:
            if chars[v] and linked[v] < chars[v]:
                c, lc = chars[v], max(1, linked[v])
                t, lt = max(1, tags[v]), max(1, link_tags[v])
                base = log(c / (c - linked[v]) * lc + share * c + e)
                density[v] = max(0.0, c / t * log(c / lc * t / lt) / log(base))
        self.unlinked = [a - b for a, b in zip(chars, linked, strict=True)]
        self.best_below = best = list(range(n))
        for v in reversed(block):
            # what stands in the node itself counts as one more child
            sums[v] += density[v] * own[v] / max(1, chars[v])
            if sums[best[v]] <= sums[v]:
                best[v] = v
            if v:
                up = home[parents[v]]
                sums[up] += density[v]
                if best[up] == up or sums[best[v]] >= sums[best[up]]:
                    best[up] = best[v]


def _has_twins(page: Page, keep: list[bool], d: Densities, v: int) -> bool:
    """Whether ``v`` is one of several sections: siblings of its name and class, with text."""
    kind = (page.attributes[v] or {}).get("class", "")
    if not kind and page.names[v] != "section":
        return False
    for w in range(page.parents[v] + 1, len(page.names)):
        if w != v and page.parents[w] == page.parents[v] and keep[w] and page.names[w] == page.names[v] and d.density[w]:
            if (page.attributes[w] or {}).get("class", "") == kind:
                return True
    return False


def article_nodes(page: Page, keep: list[bool]) -> list[bool]:
    """Which nodes are the article: kept, and in one of the selected subtrees."""
    d = Densities(page, keep)
    names, parents = page.names, page.parents
    n = len(names)
    best = d.best_below[d.body]
    path = [best]
    while path[-1] != d.body and path[-1] > 0:
        path.append(parents[path[-1]])
    threshold = min(d.density[v] for v in path if names[v] in BLOCKS)
    chosen = [False] * n
    region = next((v for v in path if names[v] == "article"), None)
    if region is not None:
        chosen[region] = True
    else:
        region = next((v for v in path if names[v] == "main"), d.body)
        while best != region and _has_twins(page, keep, d, best):
            best = parents[best]
            threshold = min(d.density[v] for v in path[path.index(best) :] if names[v] in BLOCKS)
        blocks = set(d.block)
        dense = [False] * n
        for v in range(region, n):
            at = v == region or dense[parents[v]]
            if at and v not in blocks:
                dense[v] = keep[v]
            elif at and d.density[v] >= threshold and d.density[v] > 0:
                dense[v] = True
                chosen[d.best_below[v]] = True
        chosen[best] = d.unlinked[best] > 0
        first = next((v for v in range(n) if chosen[v]), n)
        title = [v for v in range(region, first) if names[v] == "h1" and keep[v]]
        if title:
            chosen[title[-1]] = True
    for v in range(1, n):
        chosen[v] = keep[v] and (chosen[v] or chosen[parents[v]])
    chosen[0] = chosen[0] and keep[0]
    return chosen


def main_text(page: str) -> str:
    """The article's blocks, one a line, white space inside each turned into single spaces."""
    tree = Page(page)
    chosen = article_nodes(tree, kept_nodes(tree))
    home = list(range(len(tree.names)))
    for v in range(1, len(home)):
        if tree.names[v] not in BLOCKS:
            home[v] = home[tree.parents[v]]
    lines: list[list[str]] = [[]]
    last = None  # the block of the line, until another starts
    for v, t in tree.events:
        if t is None:
            if tree.names[v] in BLOCKS:
                last = None
            elif tree.names[v] == "br":
                lines[-1].append(" ")
        elif chosen[v]:
            if last != home[v]:
                lines.append([])
                last = home[v]
            lines[-1].append(t)
    return "\n".join(x for x in (" ".join("".join(parts).split()) for parts in lines) if x)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with columns main_text and n_chars (its code points, long).

    Blocks are elements that start a line by themselves, table cells among them; a line break inside
    a block is white space, as is a non-breaking space. Character references are decoded as browsers
    do. Tags need not be closed or nested well. Text inside an ``article`` that leads to the
    largest sum is taken whole; elsewhere the chosen subtrees are, and the h1 before them.
    Null or empty html, or a page without such text (or with linked text alone): empty. Pages of
    any length are read whole. Repeated rows get equal results. Empty table: no rows. Other columns
    pass through; a new column whose name is taken gets an underscore.
    """

    def make(rows: list[str]):
        texts = [main_text(r) for r in rows]
        return texts, [len(t) for t in texts]

    return with_columns(pages, {"main_text": "string", "n_chars": "long"}, make, html_col)
