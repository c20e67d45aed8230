"""URL parsing, classification, scoring and patterns as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path patterns by class, searched in the lower-case path with a slash added at its end.
PRODUCT = ["/product(s)?/", "/item(s)?/", "/p/", "/dp/", "/gp/product/", "/detail(s)?/", "/goods/", "/sku/", "/shop/"]
CATEGORY = ["/category(s)?/", "/catalog/", "/collection(s)?/", "/department(s)?/", "/shop/", "/list/", "/search/"]
LOW_VALUE = ["/cart", "/checkout", "/login", "/signup", "/register", "/account", "/wishlist", "/contact", "/about", "/help", "/faq", "/terms", "/privacy", "/shipping", "/returns", "/tracking", "/order-status"]
# Worth of known hosts, the first that is contained in the host counts.
DOMAIN_VALUE = {"amazon.com": 1.0, "walmart.com": 0.9, "target.com": 0.85, "ebay.com": 0.9, "etsy.com": 0.8, "aliexpress.com": 0.75, "shopify.com": 0.7}
# Substrings of the lower-case URL that decide how long a result stays valid, in seconds.
TTL_PRODUCT = ["/dp/", "/product/", "/item/", "/p/", "/gp/"]
TTL_LISTING = ["/search", "/category", "/catalog", "/listing", "/collections"]
TTL_ARTICLE = ["article", "news", "blog", "post", "detail", "s?id="]
# Substrings of the lower-case URL that mark an article.
ARTICLE = ["baijiahao", "zhuanlan", "weixin", "mp.weixin", "article", "news", "detail", "story", "post", "blog", "s?id=", "thread", "read", "view"]


def alternation(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def host(url: Column) -> Column:
    """Lower-case host name, null if there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain(url: Column) -> Column:
    return F.coalesce(host(url), F.lit("unknown"))


def path(url: Column) -> Column:
    """The path without the parameters of its last segment; empty if there is none."""
    parsed = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    return F.regexp_replace(parsed, ";[^/]*$", "")


def _slashed(p: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(p), "/$", ""), F.lit("/"))


def url_class(url: Column) -> Column:
    p = _slashed(path(url))
    return F.when(p.rlike(alternation(PRODUCT)), "product").when(p.rlike(alternation(CATEGORY)), "category").when(p.rlike(alternation(LOW_VALUE)), "low_value").otherwise("unknown")


def domain_value(url: Column) -> Column:
    h = F.coalesce(host(url), F.lit(""))
    return reduce(lambda c, kv: c.when(F.contains(h, F.lit(kv[0])), kv[1]), DOMAIN_VALUE.items(), F).otherwise(0.0)


def url_score(url: Column, value: Column | None = None, recency_hours: Column | None = None) -> Column:
    """0 to 100: the class's base, up to 10 for the host's worth, up to 5 for the hours since the last visit; truncated."""
    kind = url_class(url)
    score = F.when(kind == "product", 85.0).when(kind == "category", 60.0).when(kind == "low_value", 5.0).otherwise(30.0)
    score = score + (domain_value(url) if value is None else value) * 10
    if recency_hours is not None:
        score = score + F.least(F.lit(5.0), recency_hours / 24.0)
    return F.least(F.lit(100), F.greatest(F.lit(0), score.cast("int")))


def url_topic(priority: Column) -> Column:
    return F.when(priority >= 70, "high").when(priority >= 30, "normal").otherwise("low")


def path_pattern(p: Column, last_slug: bool = True) -> Column:
    """The path with identifier-like segments as placeholders; last_slug also replaces a plain last segment."""
    segments = F.split(F.regexp_replace(p, "^/+|/+$", ""), "/")

    def one(s: Column, i: Column) -> Column:
        out = F.when(s.rlike("^[A-Z0-9]{8,}$"), "{sku}").when(s.rlike("^[a-z0-9]+-[a-z0-9-]+$"), "{slug}").when(s.rlike("^[0-9]+$"), "{id}")
        if last_slug:
            out = out.when((i == F.size(segments) - 1) & s.rlike("^[A-Za-z0-9_-]+$"), "{slug}")
        return out.otherwise(s)

    return F.concat(F.lit("/"), F.array_join(F.transform(segments, one), "/"))


def link_path(page_path: Column, href: Column) -> Column:
    """The path that a link leads to, resolved against its page's path; null where a link has none, as mailto:."""
    rest = F.regexp_replace(F.trim(href), r"[?#].*$", "")
    absolute = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*"
    base = F.regexp_replace(page_path, "[^/]*$", "")
    whole = F.when(rest.rlike(absolute), F.regexp_replace(rest, absolute, "")).when(rest.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(rest == "", page_path).when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(base, rest))
    none = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s.isin("", "."), acc).otherwise(F.array_append(acc, s))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(F.regexp_replace(whole, ";[^/]*$", ""), "/"), none, step), "/"))


def pattern_regex(pattern: Column) -> Column:
    """A regular expression that a path must begin with: placeholders stand for a segment, * for part of one."""
    escaped = F.regexp_replace(pattern, r"([\\.+?^$()\[\]|])", r"\\$1")
    named = F.regexp_replace(escaped, r"\{(id|sku|slug|category)\}", "[^/]+")
    return F.concat(F.lit("^"), F.regexp_replace(named, r"\*", "[^/]*"))


def url_ttl(url: Column) -> Column:
    u = F.lower(url)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(u, F.lit(w)) for w in words])
    return F.when(has(TTL_PRODUCT), 3600).when(has(TTL_LISTING), 21600).when(has(TTL_ARTICLE), 86400).otherwise(3600)


def is_article(url: Column) -> Column:
    u = F.lower(url)
    return reduce(lambda a, b: a | b, [F.contains(u, F.lit(w)) for w in ARTICLE])


def dedup_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def engine_bucket(url: Column, buckets: int = 100000) -> Column:
    """A stable bucket of the URL without its query."""
    return F.conv(F.substring(F.md5(F.substring_index(url, "?", 1)), 1, 8), 16, 10).cast("long") % buckets
