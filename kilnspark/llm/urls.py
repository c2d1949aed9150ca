"""URL filters with redirect equivalence.

Rules give a verdict for a host with its subdomains and a path prefix. Pages that no rule fits take part in the equivalence
of redirect and canonical-link edges: inside a connected component a block is passed on to the aliases, unless some member is
allowed by a rule, which takes precedence. Pages with a rule of their own keep its verdict.

Edges come from the pages: every `<link>` whose `rel` list holds `canonical`, and every `<meta http-equiv=refresh>` with a url in its
content. Tags are read attribute by attribute (quoted either way or not, in any order, names exact, the first of a name counts), outside comments,
scripts, styles, titles and text areas; character references are decoded. A refresh's target goes up to the quote that it opens with, or to the end.
Relative targets are resolved (RFC 3986) against the page's first `<base href>` or its url. URLs are identified by scheme and host in lower case, path
and query, without the fragment.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule, has no alias and is allowed; a
null html has no edges; rows that repeat stay; an empty table gives an empty result."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import materialize, pick
from kilnspark.llm.graph import connected_components

#: Verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where a tag that counts begins, or what is passed over as a whole.
TAG = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|title|textarea)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|<(link|meta|base)(?=[\s/>])")
ATTRIBUTE = re.compile(r"(?s)[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)|))?)")
#: A refresh's content: seconds, a separator, `url=` or nothing, the target.
REFRESH = re.compile(r"(?is)\s*[0-9.]*\s*(?:[;,]\s*|(?<=\s))(?:url\s*=\s*)?(?:\"([^\"]*)|'([^']*)|(.*))")
#: Pages without one of these words, or a coded value where it could be, have no edge.
WORTH = r"(?i)canonical|refresh|(rel|http-equiv)\s*=[^>]*&"
ADDRESS = re.compile(r"(?s)(.*?:)(//[^/?#]*)([^?#]*)(\?[^#]*)?")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_identity(url: Column) -> Column:
    """Null where there is no `://`."""
    whole = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)([^#]*)", 0)
    head, tail = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(whole != "", F.concat(ascii_lower(head), tail))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. Of equal ones the first given wins."""
    tries = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(tries):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def resolve(page: str, to: str) -> str:
    """The reference `to` on the page; as it is if absolute or if the page has no `://`."""
    at = ADDRESS.match(page)
    if at is None or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", to):
        return to
    scheme, host, path, query = (x or "" for x in at.groups())
    if to.startswith("//"):
        return scheme + to
    if not to or to[0] in "?#":
        return scheme + host + path + (query + to if to[:1] != "?" else to)
    to, rest = re.match(r"(?s)([^?#]*)(.*)", to).groups()
    out: list[str] = []
    parts = (to if to.startswith("/") else path.rpartition("/")[0] + "/" + to).split("/")[1:]
    for part in parts:
        if part == "..":
            del out[-1:]
        elif part != ".":
            out.append(part)
    if parts[-1] in (".", ".."):
        out.append("")
    return scheme + host + "/" + "/".join(out) + rest


def tags(html: str) -> Iterator[tuple[str, dict[str, str]]]:
    """(name, attributes) of the link, meta and base tags that are closed; names in lower case, values decoded."""
    at = 0
    while found := TAG.search(html, at):
        at = found.end()
        if found[2]:
            own: dict[str, str] = {}
            while one := ATTRIBUTE.match(html, at):
                at = one.end()
                if one[1]:
                    yield found[2].lower(), own
                    break
                own.setdefault(one[2].translate(ASCII_LOWER), unescape(one[3] or one[4] or one[5] or ""))


def targets(url: str, html: str) -> Iterator[str]:
    """What the page's canonical links and refreshes point to, in full."""
    base, links = None, []
    for name, own in tags(html):
        if name == "base":
            base = own.get("href") if base is None else base
        elif name == "link" and "canonical" in own.get("rel", "").translate(ASCII_LOWER).split():
            links.append(own.get("href", ""))
        elif name == "meta" and own.get("http-equiv", "").translate(ASCII_LOWER) == "refresh":
            told = REFRESH.match(own.get("content", ""))
            links.append(next((x for x in told.groups() if x is not None), "") if told else "")
    clean = lambda x: re.sub(r"[\t\n\r]", "", x).strip(" \f")
    page = resolve(url, clean(base)) if base else url
    return (resolve(page, clean(x)) for x in links if clean(x))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b) url identities joined by a redirect or canonical link. Only pages that may have one reach Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(url, to) for url, html in zip(batch["url"], batch["html"], strict=True) for to in targets(url, html)]
            yield pd.DataFrame(found, columns=["url", "full"])

    links = pages.where(F.col("url").contains("://") & F.col("html").rlike(WORTH))
    goals = links.select("url", "html").mapInPandas(run, "url string, full string")
    return goals.select(url_identity(F.col("url")).alias("a"), url_identity(F.col("full")).alias("b")).where("a is not null and b is not null")


def judge(pages: DataFrame, edges: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """Every page (columns page_id, url) with host, path, rule and verdict, after spreading blocks over the edges."""
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), url_identity(F.col("url")).alias("node"))
    ruled = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).drop("url")
    found = connected_components(edges)
    urls = found.withColumn("own", rule_of(url_host(F.col("node")), url_path(F.col("node")), rules))
    blocked = urls.groupBy("component").agg((F.max(F.col("own.verdict") == "block") & ~F.coalesce(F.max(F.col("own.verdict") == "allow"), F.lit(False))).alias("spread"))
    spread = urls.where("own is null").join(blocked.where("spread"), "component").select("node", F.lit("block").alias("passed"))
    out = ruled.join(spread, "node", "left")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "passed", F.lit(default)).alias("verdict"))


def url_report(pages: DataFrame) -> DataFrame:
    """op9: verdicts of all pages under the fixed rules and the links that the pages declare."""
    rows = pick(pages, page_id="long", url="string", html="string")
    edges = materialize(page_edges(rows), "links")
    return judge(rows.select("page_id", "url"), edges)
