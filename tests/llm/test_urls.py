"""Links of pages against the library's own HTML parser and plain components; the SQL over the same pages."""

import random
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import duckdb
import pandas as pd
import pytest

from kilnspark.llm import queries, urls

SCHEMA = "page_id long, url string, html string"


class Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.base, self.found, self.inside = None, [], None

    def handle_endtag(self, tag):
        self.inside = None if tag == self.inside else self.inside

    def handle_starttag(self, tag, attrs):
        if self.inside:  # plain text until it ends
            return
        self.inside = tag if tag in ("title", "textarea") else None
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag == "base" and "href" in own and self.base is None:
            self.base = own["href"]
        if tag == "link" and "canonical" in own.get("rel", "").lower().split():
            self.found.append(own.get("href", ""))
        if tag == "meta" and own.get("http-equiv", "").lower() == "refresh":
            _, there, rest = own.get("content", "").partition(";")
            rest = rest.strip()
            rest = rest[4:].strip() if rest.lower().startswith("url=") else rest
            self.found.append(rest[1:].split(rest[0])[0] if rest[:1] in ("'", '"') else rest)

    handle_startendtag = handle_starttag


def plain_edges(url, html):
    own = Links()
    own.feed(html)
    own.close()
    page = urljoin(url, own.base) if own.base else url
    return [(url, urljoin(page, x.strip())) for x in own.found if x.strip()]


ODD = [
    '<link rel="shortlink canonical" href="http://x.com/de/1">',
    '<link data-href="http://a.net/" href="http://q.com/de/1" rel=canonical>',
    "<link rel=canonical href=\"http://q.com/de/it's\">",
    '<meta http-equiv=refresh content="0; url=http://q.com/de/a;b">',
    '<!-- <link rel=canonical href="http://q.com/de/no"> --><LINK REL=CANONICAL HREF=/yes>',
    "<meta content=\"5;URL='/q?a=1&amp;b=2' x\" http-equiv=\"Refresh\">",
    '<link rel=canonical title="a > b" href="http://q.com/de/g" rel=other>',
    '<script>"<link rel=canonical href=http://q.com/de/s>"</script><link rel="alternate" href="http://q.com/de/t">',
    '<base href="/d/"><link rel=canonical href="e/../f?x#y"><base href="/z/">',
    '<meta http-equiv="refresh" content="5"><link rel="canonical" href="">',
    "<title><link rel=canonical href=/in-title></title><a rel=canonical href=http://q.com/de/a>x</a>",
    '<link\nrel="canonical"\thref = \'http://q.com/de/tab\' /><linkx rel=canonical href=http://q.com/de/x>',
    '<link rel="canonical" href="//q.com/fr/9"><meta name=refresh content="0;url=http://q.com/de/z">',
]


@pytest.mark.parametrize("html", ODD)
def test_targets_equal_the_parser(html):
    url = "http://s.net/p/q?r=1"
    assert list(urls.targets(url, html)) == [b for _, b in plain_edges(url, html)]


def node(url):
    at = urlsplit(url)
    return f"{at.scheme}://{at.netloc.lower()}{at.path}" + (f"?{at.query}" if at.query else "")


def plain_verdicts(pages):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for _, url, html in pages:
        for a, b in plain_edges(url, html or ""):
            root[find(node(a))] = find(node(b))

    def rule(url):
        at = urlsplit(url)
        host = at.netloc.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and at.path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    inside = {}
    for x in list(root):
        inside.setdefault(find(x), set()).add(rule(x)[1])
    out = []
    for page, url, _ in pages:
        own, verdict = rule(url)
        around = inside.get(find(node(url)), set()) if node(url) in root else set()
        spread = "block" if "block" in around and "allow" not in around else "allow"
        out.append((page, own, verdict or spread))
    return sorted(out)


def planted(n):
    """Chains, stars and pages that link nowhere; some end in blocked, some in allowed urls, some in both; all kinds of tags."""
    rng, pages = random.Random(n), []
    forms = [
        '<link rel="canonical" href="{}">', "<link href='{}' rel='nofollow canonical'/>", '<meta http-equiv="refresh" content="0; url={}">',
        "<meta content='3;URL=\"{}\"' http-equiv=REFRESH>", '<link data-href="http://no.net/" REL=canonical HREF="{}">',
    ]
    ends = ["http://x.com/de/{}", "http://b.example.org/es/{}", "http://y.com/fr/{}", "http://z.net/{}", "http://w.org/{}"]
    while len(pages) < n:
        group, size = len(pages), rng.choice([1, 2, 3, 10, 60])
        star = rng.random() < 0.5
        mine = [f"http://s{group % 97}.net/g{group}/{i}" for i in range(size)]
        for i, url in enumerate(mine):
            to = mine[0 if star else i - 1] if i else ends[rng.randrange(len(ends))].format(group)
            to = to if rng.random() < 0.7 or not i else f"{0 if star else i - 1}"
            html = rng.choice(forms).format(to) if rng.random() < 0.9 else "<p>"
            html += rng.choice(forms).format(rng.choice(ends).format(group)) if rng.random() < 0.05 else ""
            pages.append((len(pages), url, html))
    return pages


def test_verdicts_of_many_pages(spark):
    pages = planted(100_000)
    df = spark.createDataFrame(pd.DataFrame(pages, columns=["page_id", "url", "html"]), SCHEMA)
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in urls.url_report(df).collect())
    assert got == plain_verdicts(pages)


def test_sql_over_linked_pages(spark):
    pages = [*planted(2000), *[(10_000 + i, f"http://o{i}.net/p/q?r=1", h) for i, h in enumerate(ODD)], (20_000, None, None), (20_001, "none", ODD[0])]
    duck = duckdb.connect()
    duck.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    got = urls.url_report(spark.createDataFrame(pages, SCHEMA))
    want = duck.sql(queries.oracle_sql()["op9_url_filters"]).select(", ".join(got.columns)).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
