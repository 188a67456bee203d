"""URL rules, and block decisions carried along redirects and canonical links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import LOWER, UPPER, ascii_lower, free, portions, save, small_batches
from lamina.llm.components import connected_components
from lamina.llm.html_text import pieces

# Patterns of URLs.
HOST = r"^(?s:.*?)://([^/?#]*)"
PATH = r"^(?s:.*?)://[^/?#]*([^?#]*)"
TAIL = r"^(?s:.*?)://[^/?#]*([^#]*)"
_URL = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^#]*)", re.DOTALL)
_REFRESH = re.compile(r"[ \t\n\f\r]*(?:[0-9]+|(?=\.))[0-9.]*(?:[ \t\n\f\r]*[;,]|[ \t\n\f\r])[ \t\n\f\r]*(?:[uU][rR][lL][ \t\n\f\r]*=[ \t\n\f\r]*)?(?:\x22([^\x22]*)|'([^']*)|(.*))", re.DOTALL)
PORTS = {"http": ":80", "https": ":443"}
HTML_SPACE = " \t\n\f\r"
#: A page without these holds no link that counts: references to letters are numbers.
TELLING = r"(?i)<(?:link|meta)(?s:.*)(?:canonical|refresh|&#)|(?:canonical|refresh|&#)(?s:.*)<(?:link|meta)"
TEXT_BYTES = 2 << 20


def _part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return ascii_lower(_part(url, HOST))


def path_of(url: Column) -> Column:
    return _part(url, PATH)


def node_of(url: Column) -> Column:
    """What names a page: its host, path and query; null for a null url or one without ://. The
    port that a scheme has anyway is left out."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))
    host = host_of(url)
    ports = [F.when((scheme == s) & host.endswith(p), F.left(host, F.length(host) - len(p))) for s, p in PORTS.items()]
    return F.when(url.contains("://"), F.concat(F.coalesce(*ports, host), _part(url, TAIL)))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, or null. Rules are (verdict, "host/path")
    and number as many as a configuration holds; of equal rules allow wins."""
    options = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        options.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*options, F.lit(None).cast("struct<verdict:string,rule:string>"))


def link_targets(page: str) -> tuple[str | None, list[str]]:
    """The href of a page's first base, and the targets of its canonical links and refreshing meta
    tags, as its attributes hold them. Tags are read as a browser reads them: attribute by
    attribute, rel as a list of words, nothing in comments, scripts, templates or plain text."""
    base, targets, templates = None, [], 0
    for kind, name, *rest in pieces(page):
        if name == "template":
            templates = max(0, templates + (1 if kind == "start" else -1))
        if kind != "start" or templates or not rest[0]:
            continue
        a = rest[0]
        if name == "base" and base is None:
            base = a.get("href")
        elif name == "link" and "canonical" in a.get("rel", "").lower().split():
            targets.append(a.get("href", ""))
        elif name == "meta" and a.get("http-equiv", "").strip(HTML_SPACE).lower() == "refresh":
            m = _REFRESH.match(a.get("content", ""))
            targets.append(next((x for x in m.groups() if x is not None), "") if m else "")
    return base, targets


def _without_dots(path: str) -> str:
    """``path`` with its . and .. steps taken."""
    if "/." not in path:
        return path
    out: list[str] = []
    steps = path.split("/")
    for k, step in enumerate(steps):
        last = k + 1 == len(steps)
        if step == "..":
            del out[max(1, len(out) - 1) :]
            out += [""] * last
        elif step == ".":
            out += [""] * last
        else:
            out.append(step)
    return "/".join(out)


def resolved(target: str, scheme: str, host: str, path: str) -> tuple[str, str, str] | None:
    """(scheme, host, path and query) of a target on a page; None if it has no host, or is empty
    or a place on the page."""
    target = "".join(c for c in target.strip(HTML_SPACE) if c not in "\t\n\r").partition("#")[0]
    if not target:
        return None
    m = _URL.fullmatch(target)
    if m and m[2] is not None:
        scheme, host, rest = m[1].lower(), m[2], m[3]
    elif m and not (m[1].lower() == scheme and scheme):
        return None
    else:
        rest = m[3] if m else target
        if rest.startswith("//"):
            host, rest = re.match("//([^/?]*)(.*)", rest, re.DOTALL).groups()
        elif rest.startswith("?"):
            rest = path + rest
        elif not rest.startswith("/"):
            rest = (path.rpartition("/")[0] if "/" in path else "") + "/" + rest
    before, mark, query = rest.partition("?")
    return scheme, host, _without_dots(before) + mark + query


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst) for each link of each page (scheme, host, path, node, html)."""
    lower = str.maketrans(UPPER, LOWER)
    for b in portions(batches, "html", TEXT_BYTES):
        found = []
        for scheme, host, path, node, page in zip(*(b[c].to_pylist() for c in ("scheme", "host", "path", "node", "html")), strict=True):
            base, targets = link_targets(page)
            at = (scheme, host, path)
            if base is not None and (r := resolved(base, *at)):
                at = (r[0], r[1], r[2].partition("?")[0])
            for t in targets:
                r = resolved(t, *at)
                if r:
                    to = r[1].translate(lower)
                    found.append((node, to.removesuffix(PORTS.get(r[0], "\n")) + r[2]))
        yield pa.record_batch({"src": pa.array([x for x, _ in found], pa.string()), "dst": pa.array([x for _, x in found], pa.string())})


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` with columns host, path, rule and verdict.

    A rule fits its host and all subdomains, if the url's path starts with the rule's; the longest
    wins and gives the verdict. Pages that redirect to each other or name each other as canonical,
    in either direction and over any number of steps, are aliases: a page without a rule is
    blocked if a rule blocks some alias, be it a page of the table or only a target; otherwise it
    is allowed. A page that a rule allows stays allowed whatever its aliases are. ``redirects``
    (from_url, to_url) may add edges to those found in the html.

    Links are those of ``link`` elements with the word canonical in rel and of ``meta`` refreshes, resolved
    against the page's first ``base``. Of pages' names, the scheme, the fragment, a default port
    and the case of A-Z in the host don't matter; all else does, as it does to rules: an empty path
    is not /, and percent signs stay.

    Null urls, or without ://: host and path are empty, no rule, no aliases, allowed. Null html:
    no links. Repeated rows are each judged. Empty table: no rows. Other columns pass through; a
    new column whose name is taken gets an underscore.
    """
    small_batches(pages.sparkSession)
    own = [f"__url_{x}" for x in ("host", "path", "node", "rule")]
    url = F.col(url_col)
    parsed = pages.withColumns({own[0]: host_of(url), own[1]: path_of(url), own[2]: node_of(url)})
    linked = parsed.where(F.col(own[2]).isNotNull() & F.col(html_col).rlike(TELLING))
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    linked = linked.select(scheme.alias("scheme"), F.col(own[0]).alias("host"), F.col(own[1]).alias("path"), F.col(own[2]).alias("node"), F.col(html_col).alias("html"))
    edges = linked.mapInArrow(_edges, "src string, dst string")
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    edges = save(edges.where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "url-edges")
    parts = connected_components(edges)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    judged = parts.withColumn("verdict", rule_for(host_of(as_url), path_of(as_url), rules)["verdict"])
    blocked = judged.where("verdict = 'block'").select("component").distinct()
    aliases = parts.join(blocked, "component").select(F.col("node").alias("__url_alias"))
    rule = rule_for(F.col(own[0]), F.col(own[1]), rules)
    ruled = parsed.withColumn(own[3], rule)
    # pages without a node would all be one null key of the join
    out = ruled.where(F.col(own[2]).isNotNull()).join(aliases, F.col(own[2]) == F.col("__url_alias"), "left")
    out = out.union(ruled.where(F.col(own[2]).isNull()).withColumn("__url_alias", F.lit(None).cast("string")))
    verdict = F.coalesce(F.col(own[3])["verdict"], F.when(F.col("__url_alias").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    new = {"host": F.col(own[0]), "path": F.col(own[1]), "rule": F.col(own[3])["rule"], "verdict": verdict}
    return out.select(*pages.columns, *[x.alias(free(pages, c)) for c, x in new.items()])
