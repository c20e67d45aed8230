from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pagelathe import api
from pagelathe.functions import urls as U
from pagelathe.operators.rules import rules_for
from pagelathe.sources.text import found_urls, url_lines


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url,least,most,kind",
    [
        ("https://amazon.com/product/123", 85, 100, "product"),
        ("https://a.com/dp/B00X", 85, 100, "product"),
        ("https://a.com/item/5", 85, 100, "product"),
        ("https://a.com/gp/product/1", 85, 100, "product"),
        ("https://a.com/shop/x", 85, 100, "product"),
        ("https://a.com/cart", 0, 10, "low_value"),
        ("https://a.com/login", 0, 10, "low_value"),
        ("https://a.com/checkout/pay", 0, 10, "low_value"),
        ("https://a.com/category/shoes", 50, 85, "category"),
        ("https://a.com/search?q=x", 50, 85, "category"),
        ("https://a.com/random-page", 30, 30, "unknown"),
        ("https://AMAZON.com/PRODUCTS/1", 95, 95, "product"),
        ("not a url", 30, 30, "unknown"),
        ("", 30, 30, "unknown"),
    ],
)
def test_score_and_class(spark, url, least, most, kind):
    assert least <= one(spark, U.url_score(F.col("u")), u=url) <= most
    assert one(spark, U.url_class(F.col("u")), u=url) == kind


def test_truncation_not_rounding(spark):
    assert one(spark, U.url_score(F.col("u"), recency_hours=F.lit(23.0)), u="https://target.com/product/1") == 94  # 85 + 8.5 + 0.95
    assert one(spark, U.url_score(F.col("u"), value=F.lit(9.0)), u="https://a.com/product/1") == 100


@pytest.mark.parametrize("priority,topic", [(90, "high"), (70, "high"), (69, "normal"), (50, "normal"), (30, "normal"), (29, "low"), (10, "low")])
def test_topic(spark, priority, topic):
    assert one(spark, U.url_topic(F.lit(priority)), u="") == topic


@pytest.mark.parametrize(
    "path,inner,cached",
    [("/products/abc-123", "/products/{slug}", "/products/{slug}"), ("/dp/B09XYZ12", "/dp/{sku}", "/dp/{sku}"), ("/category/electronics", "/category/{slug}", "/category/electronics"), ("/item/12345/", "/item/{id}", "/item/{id}"), ("/", "/", "/"), ("/a.b/c.html", "/a.b/c.html", "/a.b/c.html")],
)
def test_patterns(spark, path, inner, cached):
    assert one(spark, U.path_pattern(F.col("p")), p=path) == inner
    assert one(spark, U.path_pattern(F.col("p"), last_slug=False), p=path) == cached


def test_match_is_a_prefix_with_placeholders(spark):
    cases = [("/products/{id}", "/products/123", True), ("/products/*", "/products/123", True), ("/products/{id}", "/products/1/reviews", True), ("/products/{id}", "/x/products/1", False), ("/a.b", "/axb", False), ("/p/*/end", "/p/a/b/end", False)]
    df = spark.createDataFrame(cases, "pattern string, path string, expected boolean")
    got = df.withColumn("re", U.pattern_regex(F.col("pattern"))).select("expected", F.expr("path RLIKE re").alias("got")).collect()
    assert [r.got for r in got] == [r.expected for r in got]


def test_domain_and_path(spark):
    assert one(spark, U.domain(F.col("u")), u="https://A.Com:80/x") == "a.com"
    assert one(spark, U.domain(F.col("u")), u="nothing") == "unknown"
    assert one(spark, U.path(F.col("u")), u="https://a.com/x/y;p=1?q#f") == "/x/y"


def test_rules_join(spark):
    pages = spark.createDataFrame([(1, "https://ebay.com/item/5"), (2, "https://ebay.com/none"), (3, None)], "id long, url string")
    rules = spark.createDataFrame([("r1", "ebay.com", "/item/{id}"), ("r2", "ebay.com", "/*"), ("r3", "x.com", "/item/{id}")], "rule_id string, domain string, path_pattern string")
    assert sorted((r.id, r.rule_id) for r in rules_for(pages, rules).collect()) == [(1, "r1"), (1, "r2"), (2, "r2")]
    assert sorted(r.id for r in rules_for(pages, rules, how="left_anti").collect()) == [3]


def test_lists(spark):
    lines = spark.createDataFrame([(" https://a ",), ("",), ("# x",), (None,)], "value string")
    assert [r.url for r in url_lines(lines).collect()] == ["https://a"]
    assert [r.url for r in url_lines(lines, only_http=False).collect()] == ["https://a", "# x"]
    assert one(spark, F.array_join(found_urls(F.col("t")), " "), t="see http://a/b and https://c d") == "http://a/b https://c"
    assert one(spark, F.array_join(found_urls(F.col("t")), " "), t="plain") == "plain"


def test_submit(spark):
    got = {r.url: r for r in api.submit(spark.createDataFrame([("https://a.com/product/1",), ("x",)], "url string")).collect()}
    assert got["https://a.com/product/1"].priority == 85 and got["https://a.com/product/1"].topic == "high" and got["x"].domain == "unknown"
    assert {r.status for r in api.submit(spark.createDataFrame([("u",)], "url string"), priority=101).collect()} == {"invalid"}


def test_matching_patterns(spark):
    """Against a regular expression tried on every pair."""
    from pagelathe.operators.rules import matching

    paths = ["/search/x", "/search", "/item/5/y", "/login2", "/a+b/c", "", None, "/"]
    patterns = ["/search/*", "/item/{id}", "/login", "/a+b/{slug}", "*", "/{id}", None]
    left = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "id int, path string")
    right = spark.createDataFrame([(p,) for p in patterns], "path_pattern string")
    got = sorted((r.id, r.path_pattern) for r in matching(left, right).collect())
    regex = lambda p: "^" + re.sub(r"\\\*", "[^/]*", re.sub(r"\\\{(?:id|sku|slug|category)\\\}", "[^/]+", re.escape(p)))
    assert got == sorted((i, p) for i, u in enumerate(paths) if u is not None for p in patterns if p is not None and re.search(regex(p), u))
    assert matching(left, right.limit(0)).collect() == []
