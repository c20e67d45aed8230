"""The link graph of whole path patterns against plain Python."""

from __future__ import annotations

import re
from collections import defaultdict
from urllib.parse import urljoin, urlsplit

import pytest

from pagelathe.plans import catalog

SF = "/root/testdata/sf0.001"
LINKS = ["/shop/item/1", "/shop/item/2", "/shop/sale/red", "https://www.a.example/help/contact/", "//b.example/imprint.html", "../up/x.html", "deep/y.html", "?page=2", "#top", "mailto:a@b.example", "HTTP://c.example"]
PAGES = [(1, "https://www.a.example/shop/list/one", LINKS), (2, "https://m.a.example/shop/lists/B00000001/z.html", LINKS[:4]), (3, "https://a.example/about", LINKS[2:5]), (4, "https://z.example/", [])]


def pattern(path: str) -> str:
    parts = path.strip("/").split("/")
    for i, s in enumerate(parts):
        last = i == len(parts) - 1 and re.search("^[A-Za-z0-9_-]+$", s)
        parts[i] = "{sku}" if re.search("^[A-Z0-9]{8,}$", s) else "{slug}" if re.search("^[a-z0-9]+-[a-z0-9-]+$", s) else "{id}" if re.search("^[0-9]+$", s) else "{slug}" if last else s
    return "/" + "/".join(parts)


def expected(pages) -> set[tuple[str, str, str]]:
    out = set()
    for url, html in pages:
        for href in re.findall(r'(?i)<a\s[^>]*href="([^"]*)"', html):
            to = urlsplit(urljoin(url, href))
            if to.scheme in ("http", "https"):
                out.add((".".join(urlsplit(url).hostname.split(".")[-2:]), pattern(urlsplit(url).path), pattern(to.path)))
    return out


@pytest.fixture(scope="module", params=["fixture", "table"])
def case(request, spark, tmp_path_factory):
    if request.param == "table":
        return SF, expected([(r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()])
    d = str(tmp_path_factory.mktemp("sitemap"))
    rows = [(i, url, " ".join(f'<a class="l" href="{h}">x</a>' for h in hrefs)) for i, url, hrefs in PAGES]
    spark.createDataFrame(rows, spark.read.parquet(f"{SF}/pages.parquet").schema).write.parquet(f"{d}/pages.parquet")
    return d, expected([r[1:] for r in rows])


@pytest.mark.parametrize("name", ["agg_hubs", "agg_hubs_in"])
def test_hubs(spark, case, name):
    near = defaultdict(set)
    for domain, src, dst in case[1]:
        own, other = (src, dst) if name == "agg_hubs" else (dst, src)
        near[(domain, own)].add(other)
    got = {(r.domain, r.pattern): r.n for r in catalog.queries()[name](spark, case[0]).collect()}
    assert got == {k: len(v) for k, v in near.items() if len(v) >= 3}


def test_coverage_and_unvisited(spark, case):
    known, visited = defaultdict(set), defaultdict(set)
    for domain, src, dst in case[1]:
        known[domain] |= {src, dst}
        visited[domain].add(src)
    got = {r.domain: (r.total, r.visited, r.unvisited) for r in catalog.queries()["agg_sitemap"](spark, case[0]).collect()}
    assert got == {d: (len(k), len(visited[d]), len(k - visited[d])) for d, k in known.items()}
    left = {(r.domain, r.pattern) for r in catalog.queries()["set_except"](spark, case[0]).collect()}
    assert left == {(d, p) for d, k in known.items() for p in k - visited[d]}
