from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import extraction as X
from pagelathe.operators import selectors as S
from pagelathe.operators.cascade import extract, extract_and_heal

JSONLD = """<html><head><script type="application/ld+json">{"@context":"x","@type":"Product","name":"Chair","sku":"JLD-001","brand":{"name":"Acme"},"image":["a.jpg","b.jpg"],
"offers":[{"@type":"Offer","price":"49.99","priceCurrency":"EUR"}],"aggregateRating":{"ratingValue":"4.7","reviewCount":12}}</script>
<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type":"Product","name":"Second","description":"d"}</script></head></html>"""
PRODUCT = """<html><head><meta property="og:title" content="OG"><meta name="description" content=" Desc "><meta property="product:price:currency" content="USD"></head>
<body><h1>Title &amp; <b>bold</b></h1><div class="big price-now">$ 1,799.00</div><span itemprop="brand">Br</span><link itemprop="availability" content="InStock">
<ul class="breadcrumb-list"><li><a>One</a><li><a>Two</a><a>Three</a></ul><p data-sku="1">S-1</body>"""
JUNK = "<html><body>only words here</body></html>"


def fields(spark, html):
    return spark.createDataFrame([(html,)], "html string").select(X.json_ld_fields(F.col("html")).alias("f")).first().f


def test_structured_data(spark):
    f = fields(spark, JSONLD)
    assert f == {"title": "Chair", "sku": "JLD-001", "brand": "Acme", "image": "a.jpg", "price": "49.99", "currency": "EUR", "rating_value": "4.7", "review_count": "12", "description": "d"}
    assert fields(spark, JUNK) == {} and fields(spark, "") == {}


@pytest.mark.parametrize(
    "text,price,sku,rating,reviews",
    [("now $1,299.50!", 1299.5, None, None, None), ("€ 15", 15.0, None, None, None), ("15.99 GBP", 15.99, None, None, None), ("sku: ab-1234 4.5 stars 1,024 reviews", None, "ab-1234", 4.5, "1024"), ("Item # X9Y8, 4 out of 5", None, "X9Y8", 4.0, None), ("nothing", None, None, None, None)],
)
def test_patterns(spark, text, price, sku, rating, reviews):
    c = F.col("t")
    r = spark.createDataFrame([(text,)], "t string").select(X.price(c).alias("p"), X.sku(c).alias("s"), X.rating(c).alias("r"), X.reviews(c).alias("v")).first()
    assert tuple(r) == (price, sku, rating, reviews)


def merged(spark, rows, f=X.merge):
    kind = "fields array<struct<name:string,value:string,confidence:double>>"
    return spark.createDataFrame([(rows,)], kind).select(f(F.col("fields")).alias("m")).first().m


def test_merge_ignores_the_old_confidence(spark):
    assert merged(spark, [("a", "1", 1.0), ("a", "2", 0.75)]) == {"a": "2"}
    assert merged(spark, [("a", "1", 0.5), ("a", "2", 0.7)]) == {"a": "1"}
    assert merged(spark, [("a", "1", 0.5), ("a", "2", 0.95), ("a", "3", 0.7), ("b", "x", 0.1)]) == {"a": "2", "b": "x"}
    assert merged(spark, []) == {}
    assert merged(spark, [("a", "1", 1.0), ("a", "2", 0.75)], X.merge_best) == {"a": "1"}


def test_default_selectors(spark):
    pages = spark.createDataFrame([(1, "https://www.x.com/", PRODUCT), (2, None, JUNK), (3, "https://www.amazon.com/dp/1", '<h1>h</h1><b id="productTitle"> A  B </b>'), (4, "u", None)], "page_id long, url string, html string")
    got = {}
    for r in S.default_fields(pages, "page_id").collect():
        got.setdefault(r.page_id, {})[r.name] = r.value
    assert got == {1: {"title": "Title & bold", "description": "Desc", "price": "$ 1,799.00", "currency": "USD", "sku": "S-1", "brand": "Br", "availability": "InStock", "category": "One"}, 3: {"title": "A B"}}


@pytest.mark.parametrize(
    "selector,expected",
    [("p", ["a", "b", "c"]), ("div p", ["a", "b"]), ("#x", ["b"]), (".k.l", ["b"]), ("p.k, #z", ["b", "c"]), ("[data-v]", ["c"]), ("[data-v='7']", ["c"]), ("[class*='k']", ["b"]), ("div p:last-child", ["b"]), ("p:first-child", ["a"])],
)
def test_css(selector, expected):
    doc = S.parse('<div><p>a<p id="x" class="k l">b</div><p id="z" data-v="7">c</p>')
    assert [n.text() for n in S.compile_css(selector)(doc)] == expected


def test_xpath():
    doc = S.parse("<div a='1'><b>x</b><i>y</i></div><div><b>z</b></div>")
    assert list(S.compile_xpath("//b//text()")(doc)) == ["x", "z"]
    assert [n.tag for n in S.compile_xpath("//div[@a='1']/*")(doc)] == ["b", "i"]
    assert list(S.compile_xpath("//div/@a")(doc)) == ["1"]
    with pytest.raises(ValueError, match="not supported"):
        S.compile_xpath("count(//a)")
    doc = S.parse("<ul><li>1<li class='k'>2<li>3</ul><ul><li>4</ul>")
    path = lambda p: [n.text() for n in S.compile_xpath(p)(doc)]
    assert path("//li[1]") == ["1", "4"] and path("//li[last()]") == ["3", "4"] and path("//ul/li[2]") == ["2"]
    assert path("//li[@class]") == ["2"] and path("//li[contains(@class, 'k')]") == ["2"] and path("//li[text()='3']") == ["3"]
    assert path("//li[contains(text(), '4')]") == ["4"] and path("//li[@class='k']/..") == ["123"] and path("//li[1] | //li[@class]") == ["1", "4", "2"]


@pytest.mark.parametrize(
    "selector,expected",
    [
        ("ul > li", "1234"), ("div > li", ""), ("li + li", "23"), ("li.k ~ li", "3"), ("li:nth-child(2)", "2"), ("li:nth-child(odd)", "134"), ("li:nth-child(2n+1)", "134"), ("li:nth-child(-n+2)", "124"),
        ("li:nth-last-child(1)", "34"), ("li:not(.k)", "134"), ("li:only-child", "4"), ("li:first-of-type", "14"), ("[class~='j']", "2"), ("[lang|='en']", "3"), ("ul li:not(:first-child)", "23"), ("div ul>li , p", "1234"),
        ("li:nope", ""), ("a >", ""), ("> li", ""), ("li[", ""), ("li:nth-child(x)", ""), ("", ""), ("li,,p", ""),
    ],
)
def test_css_combinators_and_broken_selectors(selector, expected):
    """A selector that can't be read matches nothing: rules are data."""
    doc = S.parse("<div><ul><li>1<li class='j k'>2<li lang='en-GB'>3</ul><ul><li>4</ul></div>")
    assert "".join(n.text() for n in S.compiled("css", selector)(doc)) == expected
    assert list(S.compiled("xpath", "count(//a)")(doc)) == list(S.compiled("regex", ".*")(doc)) == []


def test_rules_from_data(spark):
    """A broken rule is skipped, and the others still count."""
    pages = spark.createDataFrame([(1, "<h2>x</h2>"), (None, "<h2>y</h2>"), (1, None)], "page_id long, html string")
    got = S.apply_rules(pages, [("a", "css", "h2 >> b", None), ("b", "xpath", "//h2[[", None), ("c", "css", "h2", None)], "page_id").collect()
    assert {(r.page_id, r.name, r.value) for r in got} == {(1, "c", "x"), (None, "c", "y")}


def test_deep_and_broken_html():
    assert S.parse("<div>" * 5000 + "x").root.text() == "x"
    assert S.parse("<p <b>< &#xfffffff; <!-- <").root.text() is not None
    assert S.article(None)["content"] is None


def test_article():
    a = S.article('<html><body><h1> A  title </h1><span class="author-x">Me</span><time datetime="2024-01-02">x</time><p>' + "long text " * 10 + "</p></body>")
    assert (a["title"], a["author"], a["date"]) == ("A title", "Me", "2024-01-02") and a["content"].startswith("A title Mexlong")
    b = S.article("<body>作者：张三 2024/05/06 07:08 。这是一个足够长的句子用来测试描述字段的提取是否符合预期并且长度超过三十个字。</body>")
    assert b["author"] == "张三" and b["date"] == "2024/05/06 07:08" and b["description"].startswith("这是")


def test_signature_depends_on_structure_only(spark):
    rows = [(1, "<div class='b a'><p>x</p></div>"), (2, "<div class='a b'><p>other</p><p>y</p></div>"), (3, "<div><p>x</p></div>"), (4, "plain"), (5, "plain"), (6, None)]
    got = {r.page_id: r.signature for r in S.dom_signatures(spark.createDataFrame(rows, "page_id long, html string"), "page_id").collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5] and len({*got.values()}) == 4 and all(len(s) == 20 for s in got.values())


def test_cascade(spark):
    pages = spark.createDataFrame([(1, "u", JSONLD), (2, "u", PRODUCT + "<p>SKU: ZZ-1234</p>"), (3, "u", JUNK), (4, "u", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in extract(pages, "page_id").collect()}
    assert got[1].extractors == ["structured"] and got[1].missing == [] and got[1].success
    assert got[2].extractors == ["selectors"] and got[2].fields["title"] == "Title & bold" and got[2].missing == ["image"]
    assert not got[3].success and got[3].fields == {} and len(got[3].missing) == 6 and not got[4].success
    hook = lambda html, url: F.array(F.struct(F.lit("image").alias("name"), F.lit("m.png").alias("value"), F.lit(0.85).alias("confidence")))
    asked = {r.page_id: r.fields.get("image") for r in extract(pages, "page_id", model=hook).collect()}
    assert asked == {1: "a.jpg", 2: "m.png", 3: "m.png", 4: "m.png"}


def test_cascade_keeps_rows_apart(spark):
    """Repeated and null ids: each row is extracted from its own page."""
    rows = [(1, "u", JSONLD), (1, "u", PRODUCT), (None, "u", PRODUCT), (None, "u", JUNK), (2, None, "")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id").collect()
    assert sorted((str(r.page_id), r.fields.get("title")) for r in got if r.fields) == [("1", "Chair"), ("1", "Title & bold"), ("None", "Title & bold")]
    assert len(got) == 5 and extract(spark.createDataFrame([], "page_id long, url string, html string"), "page_id").collect() == []


def test_cascade_asks_a_tagger_before_patterns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Acme sells for $5</p>")], "page_id long, url string, html string")
    tagger = lambda text: F.array(F.struct(F.lit("brand").alias("name"), F.regexp_extract(text, "^[A-Z][a-z]+", 0).alias("value")))
    assert extract(pages, "page_id", entities=tagger).first().fields == {"brand": "Acme", "price": "5.0"}


def test_healing_uses_the_cache(spark):
    """A live rule is used and the model not asked; an expired one is asked for again; its answer is cached."""
    kind = f"domain string, path_pattern string, rules {S.RULES}, expires_at timestamp"
    rule = lambda s: [("brand", "css", s, None)]
    at = lambda t: F.lit(t).cast("timestamp")
    pages = spark.createDataFrame([(1, "https://a.x/p/1", "<i>live</i><b>new</b>"), (2, "https://b.x/p/2", "<i>old</i><b>new</b>"), (3, "https://c.x/p/3", "<u>none</u>")], "page_id long, url string, html string")
    cache = spark.createDataFrame([("a.x", "/p/{id}", rule("i"), None), ("b.x", "/p/{id}", rule("i"), None)], kind).withColumn("expires_at", F.when(F.col("domain") == "a.x", at("2024-01-02")).otherwise(at("2023-12-31")))
    model = lambda html: F.when(F.contains(html, F.lit("<b>")), F.array(F.struct(F.lit("brand").alias("field"), F.lit("css").alias("kind"), F.lit("b").alias("selector"), F.lit(None).cast("string").alias("attribute")))).otherwise(F.array().cast(S.RULES))
    found, added = extract_and_heal(pages, cache, at("2024-01-01"), model, "page_id")
    assert {r.page_id: r.fields.get("brand") for r in found.collect()} == {1: "live", 2: "new", 3: None}
    assert [(r.domain, r.path_pattern, r.rules[0].selector, str(r.expires_at)) for r in added.collect()] == [("b.x", "/p/{id}", "b", "2024-01-02 00:00:00")]


def test_healing_extracts_once_and_moves_no_page_by_kind(spark):
    """No page is parsed for the first extraction in the returned plans, no page is shuffled by its kind, and a narrow table is
    dealt out before pages are made of it. Null and repeated ids, URLs and pages keep their rows."""
    from pagelathe.plans import adapter_queries as Q
    from pagelathe.sources import tables as T

    rows = [(1, "https://a.x/p/2", "<b>one</b>"), (1, "https://a.x/p/1", "<b>two</b>"), (None, "https://a.x/p/1", "<b>two</b>"), (3, None, "<b>x</b>"), (4, "https://a.x/p/1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    cache = spark.createDataFrame([], f"domain string, path_pattern string, rules {S.RULES}, expires_at timestamp")
    rule = F.struct(F.lit("brand").alias("field"), F.lit("css").alias("kind"), F.lit("b").alias("selector"), F.lit(None).cast("string").alias("attribute"))
    model = lambda html: F.when(F.contains(html, F.lit("<b>")), F.array(rule)).otherwise(F.array().cast(S.RULES))
    found, added = extract_and_heal(pages, cache, F.lit("2024-01-01").cast("timestamp"), model, "page_id")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(found).count("ArrowEvalPython") == 1 and "SortMergeJoin" not in plan(found) and "hashpartitioning" not in plan(found)
    assert "Python" not in plan(added)
    assert sorted(((r.page_id, r.fields.get("brand")) for r in found.collect()), key=str) == [(1, "one"), (1, "two"), (3, None), (4, None), (None, "two")]
    assert [(r.domain, r.path_pattern) for r in added.collect()] == [("a.x", "/p/{id}")]
    assert T.product_pages(spark, "/root/testdata/sf0.001", rows=50).rdd.getNumPartitions() == 4 and Q.PARSED <= 10_000


def test_table_functions(spark):
    from pagelathe.functions import udtf

    udtf.register(spark)
    spark.createDataFrame([(1, PRODUCT + "<a href='/x'>y</a>"), (2, None)], "page_id long, html string").createOrReplaceTempView("udtf_pages")
    rows = spark.sql("SELECT page_id, f.name, f.value FROM udtf_pages, LATERAL extract_fields(html, 'u') f").collect()
    assert {r.page_id for r in rows} == {1} and ("title", "Title & bold") in {(r.name, r.value) for r in rows}
    assert [(r.position, r.href) for r in spark.sql("SELECT l.* FROM udtf_pages, LATERAL html_links(html) l").collect()] == [(0, "/x")]


def test_a_node_is_cast_once(spark):
    """Objects, lists, scalars and nulls where a node's members are expected; the plan casts a node's members once."""
    from pagelathe.functions import extraction as X

    def page(*blocks):
        return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)

    rows = [
        page('{"@type":["Product","X"],"name":"n","brand":[{"name":"b"}],"image":{"url":"u"},"category":{"name":"c"},"offers":[{"price":1.5,"availability":{"name":"in"}}],"aggregateRating":{"ratingValue":4}}'),
        page('{"@type":"Product","name":null,"brand":"plain","image":[{"url":"u1"},"u2"],"category":"c","offers":{"price":"2","priceCurrency":"EUR","priceValidUntil":"x"},"gtin13":"e"}', '{"@type":"Product","name":"late","upc":"p"}'),
        page('{"@type":"Offer","price":3,"availability":"s"}', '[1, 2]', '"text"', "null", "{", '{"@graph":[{"@type":"Brand","name":"g"},{"@type":"Other","name":"no"}]}'),
        page('{"@type":"Product","offers":[],"aggregateRating":[],"brand":{},"image":[]}'),
        "", None,
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, html string").select("id", X.json_ld_fields(F.col("html")).alias("f"))
    got = {r.id: r.f for r in df.collect()}
    assert got[0] == {"title": "n", "brand": "b", "image": '{"url":"u"}', "category": "c", "rating_value": "4", "price": "1.5", "availability": "in"}
    assert got[1] == {"image": "u1", "category": "c", "price": "2", "currency": "EUR", "price_valid_until": "x", "ean": "e", "title": "late", "upc": "p"}
    assert got[2] == {"price": "3", "availability": "s", "brand": "g"} and not got[4] and not got[5]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("@type") <= 4
