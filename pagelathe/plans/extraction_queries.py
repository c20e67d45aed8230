"""Extraction of product and article records from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelathe.functions import extraction as X
from pagelathe.operators import selectors as S
from pagelathe.plans.registry import query
from pagelathe.sources import tables as T

_P = f"pp AS ({T.PRODUCT_PAGES})"
_STRIP = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_T = f"{_P}, t AS (SELECT page_id, url, {_STRIP} AS text FROM pp)"
_JSONLD = """(?is)<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>"""


def _first(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in patterns) + ", NULL)"


_PRICE = f"try_cast(replace({_first(X.PRICE)}, ',', '') AS DOUBLE)"
_RATING = f"try_cast({_first([X.RATING])} AS DOUBLE)"
_REVIEWS = f"replace({_first([X.REVIEWS])}, ',', '')"


def _text(spark, d):
    return T.product_pages(spark, d).select("page_id", "url", X.html_strip(F.col("html")).alias("text"))


def _each(name: str, column: str, build, sql: str) -> None:
    query(name, f"WITH {_T} SELECT page_id, {sql} AS {column} FROM t")(lambda spark, d: _text(spark, d).select("page_id", build(F.col("text")).alias(column)))


_each("price_regex", "price", X.price, _PRICE)
_each("sku_regex", "sku", X.sku, _first(X.SKU))
_each("rating_regex", "rating", X.rating, _RATING)
_each("review_regex", "reviews", X.reviews, _REVIEWS)


@query("str_ws_norm", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def str_ws_norm(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.ws_norm(F.col("text")).alias("text"))


@query("money_clean", "WITH m AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '$1,' || CAST(100 + p_partkey % 900 AS STRING) WHEN 1 THEN '€' || CAST(p_partkey AS STRING) ELSE 'about ' || CAST(p_partkey AS STRING) END AS m FROM part) SELECT p_partkey, try_cast(translate(m, '$€,', '') AS DOUBLE) AS amount, CASE WHEN try_cast(translate(m, '$€,', '') AS DOUBLE) IS NULL THEN m END AS rest FROM m")
def money_clean(spark, d):
    m = T.table(spark, d, "part").select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN '$1,' || CAST(100 + p_partkey % 900 AS STRING) WHEN 1 THEN '€' || CAST(p_partkey AS STRING) ELSE 'about ' || CAST(p_partkey AS STRING) END").alias("m"))
    amount, rest = X.money(F.col("m"))
    return m.select("p_partkey", amount.alias("amount"), rest.alias("rest"))


@query("date_regex", "WITH t AS (SELECT event_id, 'posted ' || CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 1 THEN CAST(event_id % 50 AS STRING) || '天前' ELSE 'today' END AS text FROM events) SELECT event_id, coalesce(nullif(regexp_extract(text, '([0-9]{4}[-/][0-9]{2}[-/][0-9]{2}\\s*[0-9]{2}:[0-9]{2})', 1), ''), nullif(regexp_extract(text, '([0-9]+[小分钟天]前)', 1), '')) AS found FROM t")
def date_regex(spark, d):
    shown = F.expr("'posted ' || CASE event_id % 3 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm') WHEN 1 THEN CAST(event_id % 50 AS STRING) || '天前' ELSE 'today' END")
    return T.table(spark, d, "events").select("event_id", X.date(shown).alias("found"))


@query("ex_jsonld_blocks", f"WITH {_P} SELECT page_id, len(regexp_extract_all(html, '{_JSONLD}', 1)) AS n_blocks, regexp_extract(html, '{_JSONLD}', 1) AS first_block FROM pp")
def ex_jsonld_blocks(spark, d):
    blocks = X.json_ld_blocks(F.col("html"))
    return T.product_pages(spark, d).select("page_id", F.size(blocks).cast("long").alias("n_blocks"), F.element_at(blocks, 1).alias("first_block"))


_NODES = f"""{_P}, b AS (SELECT page_id, regexp_extract(html, '{_JSONLD}', 1) AS j FROM pp), v AS (SELECT page_id, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM b),
n AS (SELECT page_id, 0 AS seq, j AS node FROM v WHERE j IS NOT NULL AND json_extract(j, '$."@graph"') IS NULL
      UNION ALL SELECT page_id, g AS seq, json_extract(j, '$."@graph"[' || g || ']') AS node FROM v, range(0, 5) r(g) WHERE j IS NOT NULL AND json_extract(j, '$."@graph"[' || g || ']') IS NOT NULL),
k AS (SELECT page_id, seq, node, coalesce(json_extract_string(node, '$."@type"[0]'), json_extract_string(node, '$."@type"')) AS kind FROM n)"""
_PRODUCT = "kind IN ('Product', 'ProductGroup', 'IndividualProduct', 'ProductModel')"
_OFFER = "kind IN ('Offer', 'AggregateOffer')"


def _wins(name: str, sql: str) -> str:
    return f"arg_min({sql}, seq) FILTER ({sql} IS NOT NULL) AS {name}"


def _js(path: str) -> str:
    return f"json_extract_string(node, '{path}')"


_COLUMNS = {
    "title": f"CASE WHEN {_PRODUCT} THEN {_js('$.name')} END",
    "sku": f"CASE WHEN {_PRODUCT} THEN {_js('$.sku')} END",
    "brand": f"CASE WHEN {_PRODUCT} THEN {_js('$.brand.name')} WHEN kind IN ('Organization', 'Brand') THEN {_js('$.name')} END",
    "image": f"CASE WHEN {_PRODUCT} THEN {_js('$.image[0]')} END",
    "rating_value": f"CASE WHEN {_PRODUCT} THEN {_js('$.aggregateRating.ratingValue')} END",
    "review_count": f"CASE WHEN {_PRODUCT} THEN {_js('$.aggregateRating.reviewCount')} END",
    "price": f"CASE WHEN {_PRODUCT} THEN {_js('$.offers.price')} WHEN {_OFFER} THEN {_js('$.price')} END",
    "currency": f"CASE WHEN {_PRODUCT} THEN {_js('$.offers.priceCurrency')} WHEN {_OFFER} THEN {_js('$.priceCurrency')} END",
    "availability": f"CASE WHEN {_PRODUCT} THEN {_js('$.offers.availability')} WHEN {_OFFER} THEN {_js('$.availability')} END",
}


@query("ex_jsonld", f"WITH {_NODES}, f AS (SELECT page_id, {', '.join(_wins(k, v) for k, v in _COLUMNS.items())} FROM k GROUP BY page_id) SELECT pp.page_id, {', '.join(_COLUMNS)} FROM pp LEFT JOIN f USING (page_id)")
def ex_jsonld(spark, d):
    """The structured fields of a page, one column each; all inside one projection, without a shuffle."""
    fields = T.product_pages(spark, d).select("page_id", X.json_ld_fields(F.col("html")).alias("f"))
    return fields.select("page_id", *(F.try_element_at("f", F.lit(c)).alias(c) for c in _COLUMNS))


@query("ex_product", f"WITH {_NODES} SELECT page_id, seq, kind, {_js('$.name')} AS title, {_js('$.sku')} AS sku, {_js('$.brand.name')} AS brand, {_js('$.offers.price')} AS price FROM k WHERE {_PRODUCT}")
def ex_product(spark, d):
    """Product nodes, one row each, with their place in the page."""
    n = T.product_pages(spark, d).select("page_id", F.posexplode(X.nodes(F.col("html"))).alias("seq", "node"))
    n = n.select("page_id", "seq", "node", X.node_type(F.col("node")).alias("kind")).where(F.col("kind").isin(X.PRODUCT_TYPES))
    get = lambda p: F.try_variant_get("node", p, "string")
    return n.select("page_id", "seq", "kind", get("$.name").alias("title"), get("$.sku").alias("sku"), get("$.brand.name").alias("brand"), get("$.offers.price").alias("price"))


@query("json_nested", f"WITH {_NODES} SELECT page_id, seq, coalesce({_js('$.offers.price')}, {_js('$.offers[0].price')}) AS price, coalesce({_js('$.image[0]')}, {_js('$.image')}) AS image FROM k")
def json_nested(spark, d):
    """Safe nested access: an object's key, or that of a list's first element."""
    n = T.product_pages(spark, d).select("page_id", F.posexplode(X.nodes(F.col("html"))).alias("seq", "node"))
    get = lambda *p: F.coalesce(*(F.try_variant_get("node", x, "string") for x in p))
    return n.select("page_id", "seq", get("$.offers.price", "$.offers[0].price").alias("price"), get("$.image[0]", "$.image").alias("image"))


_HEUR = f"SELECT page_id, 1 AS seq, 'price' AS name, CAST({_PRICE} AS STRING) AS value FROM t UNION ALL SELECT page_id, 2, 'sku', {_first(X.SKU)} FROM t UNION ALL SELECT page_id, 3, 'rating_value', CAST({_RATING} AS STRING) FROM t UNION ALL SELECT page_id, 4, 'review_count', {_REVIEWS} FROM t"


@query("ex_adaptive", f"WITH {_T} SELECT page_id, name, value, 0.5::DOUBLE AS confidence FROM ({_HEUR}) WHERE value IS NOT NULL")
def ex_adaptive(spark, d):
    """Fields found in visible text by patterns, one row each."""
    return _text(spark, d).select("page_id", F.inline(X.heuristic_fields(F.col("text"))))


# three sources of (page, source, name, value, confidence) made from part, with disagreeing values
_FIELDS = """
SELECT p_partkey AS page_id, 0 AS source, 0 AS pos, 'title' AS name, p_name AS value, 1.0 AS confidence FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 0, 1, 'price', CAST(p_partkey AS STRING), 1.0 FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 1, 0, 'title', 'css ' || p_name, 0.7 FROM part
UNION ALL SELECT p_partkey, 1, 1, 'brand', p_brand, 0.95 FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 1, 2, 'image', 'i.png', 0.95 FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey, 2, 0, 'price', '9.99', 0.5 FROM part
UNION ALL SELECT p_partkey, 2, 1, 'brand', 'other', 0.85 FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT p_partkey, 2, 2, 'sku', 'S' || CAST(p_partkey AS STRING), 0.5 FROM part
"""


def _bags(spark, d):
    f = T.relation(spark, d, _FIELDS)
    return f.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("source", "pos", "name", "value", F.col("confidence").cast("double").alias("confidence")))).alias("fields"))


_MERGED = f"f AS ({_FIELDS}), o AS (SELECT *, source * 100 + pos AS seq FROM f), m AS (SELECT page_id, name, coalesce(arg_max(value, seq) FILTER (confidence > 0.7 AND seq > lo), arg_min(value, seq)) AS value FROM (SELECT *, min(seq) OVER (PARTITION BY page_id, name) AS lo FROM o) GROUP BY page_id, name)"


@query("ex_merge", f"WITH {_MERGED} SELECT page_id, name, value FROM m")
def ex_merge(spark, d):
    """Merged fields, one row each. A page's fields are merged inside its row."""
    return _bags(spark, d).select("page_id", F.explode(X.merge(F.col("fields"))).alias("name", "value"))


@query("ex_merge_best", f"WITH f AS ({_FIELDS}) SELECT page_id, name, arg_max(value, confidence * 1000000 - source * 100 - pos) AS value FROM f GROUP BY page_id, name")
def ex_merge_best(spark, d):
    """Extension: merging by the highest confidence."""
    return _bags(spark, d).select("page_id", F.explode(X.merge_best(F.col("fields"))).alias("name", "value"))


@query("ex_first_wins", f"WITH f AS ({_FIELDS}) SELECT page_id, name, arg_min(value, source * 100 + pos) AS value FROM f GROUP BY page_id, name")
def ex_first_wins(spark, d):
    pairs = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value")))
    return _bags(spark, d).select("page_id", F.explode(X.first_wins(pairs)).alias("name", "value"))


@query("ex_to_dict", f"WITH f AS ({_FIELDS}) SELECT page_id, name, arg_max(value, source * 100 + pos) AS value FROM f GROUP BY page_id, name")
def ex_to_dict(spark, d):
    """A field bag as a map in which the last value of a name wins; the session's policy need not say so."""
    pairs = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value")))
    return _bags(spark, d).select("page_id", F.explode(X.first_wins(F.reverse(pairs))).alias("name", "value"))


@query("ex_early_stop", f"WITH f AS ({_FIELDS}), s AS (SELECT DISTINCT page_id, source FROM f), c AS (SELECT s.page_id, s.source, count(DISTINCT f.name) AS before FROM s LEFT JOIN f ON f.page_id = s.page_id AND f.source < s.source GROUP BY ALL) SELECT page_id, source FROM c WHERE before < 4")
def ex_early_stop(spark, d):
    """The sources that are still asked: those before which fewer than four distinct fields have been found."""
    fields = F.col("fields")
    sources = F.array_distinct(F.transform(fields, lambda f: f["source"]))
    before = lambda s: F.size(F.array_distinct(F.transform(F.filter(fields, lambda f: f["source"] < s), lambda f: f["name"])))
    return _bags(spark, d).select("page_id", F.explode(F.filter(sources, lambda s: before(s) < 4)).alias("source"))


@query("ex_missing", f"WITH f AS ({_FIELDS}) SELECT page_id, array_to_string(list_filter(['title', 'price', 'brand', 'sku', 'description', 'image'], lambda x: NOT list_contains(list(name), x)), ',') AS missing FROM f GROUP BY page_id")
def ex_missing(spark, d):
    return _bags(spark, d).select("page_id", F.array_join(X.missing(F.transform("fields", lambda f: f["name"])), ",").alias("missing"))


@query("ex_article_merge", f"WITH {_MERGED}, a AS (SELECT doc_id AS page_id, lang, source AS src FROM documents), w AS (SELECT a.page_id, max(CASE WHEN name = 'title' THEN value END) AS title, max(CASE WHEN name = 'brand' THEN value END) AS brand, count(name) AS n, any_value(lang) AS lang, any_value(src) AS src FROM a LEFT JOIN m USING (page_id) GROUP BY a.page_id) SELECT page_id, coalesce(title, src) AS title, brand, lang AS author, CASE WHEN n + 2 - CASE WHEN title IS NOT NULL THEN 1 ELSE 0 END >= 4 THEN 'success' ELSE 'partial' END AS status FROM w")
def ex_article_merge(spark, d):
    """Article fields overlaid by product fields; a record with fewer than four fields is partial, never invented."""
    article = T.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.create_map(F.lit("title"), "source", F.lit("author"), "lang").alias("article"))
    merged = _bags(spark, d).select("page_id", X.merge(F.col("fields")).alias("found"))
    none = F.create_map().cast("map<string,string>")
    both = article.join(merged, "page_id", "left").withColumn("found", F.coalesce("found", none))
    both = both.select("page_id", F.map_concat(F.map_filter("article", lambda k, v: ~F.map_contains_key("found", k)), "found").alias("r"))
    get = lambda c: F.try_element_at("r", F.lit(c)).alias(c)
    return both.select("page_id", get("title"), get("brand"), get("author"), F.when(F.size("r") >= 4, "success").otherwise("partial").alias("status"))


@query("ex_links", """SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages""")
def ex_links(spark, d):
    return T.table(spark, d, "pages").select("page_id", F.explode(X.links(F.col("html"))).alias("href"))


@query("preview", f"WITH f AS ({_FIELDS}), r AS (SELECT page_id, name, value, row_number() OVER (PARTITION BY page_id ORDER BY source, pos) AS n FROM f) SELECT page_id, string_agg(name || ':' || left(value, 20), ' ' ORDER BY n) AS preview FROM r WHERE n <= 4 GROUP BY page_id")
def preview(spark, d):
    """The first four fields, values cut at 20 characters."""
    shown = F.transform(F.slice("fields", 1, 4), lambda f: F.concat(f["name"], F.lit(":"), F.substring(f["value"], 1, 20)))
    return _bags(spark, d).select("page_id", F.array_join(shown, " ").alias("preview"))


@query("ex_css_native", "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\\s+', ' ', 'g')) AS h1, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def ex_css_native(spark, d):
    """The selectors h1 and title by patterns, inside generated code."""
    grab = lambda tag: X.ws_norm(F.regexp_extract("html", f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)).alias(tag)
    return T.table(spark, d, "pages").select("page_id", grab("h1"), grab("title"))


@query("ex_css_default")
def ex_css_default(spark, d):
    """Default selector rules over product pages, one row for each field found."""
    return S.default_fields(T.product_pages(spark, d), "page_id")


@query("ex_css")
def ex_css(spark, d):
    """Own selector rules over pages: every match, the first non-empty value of a field marked."""
    rules = [("headline", "css", "article h1", None), ("bold", "xpath", "//p/b//text()", None), ("target", "css", "nav a", "href"), ("never", "jsonpath", "$.x", None)]
    return S.apply_rules(T.table(spark, d, "pages"), rules, "page_id")


@query("ex_text")
def ex_text(spark, d):
    """Text content of the body with entities decoded, scripts and styles included."""
    return S.text_content(T.table(spark, d, "pages"), "page_id")


@query("ex_article")
def ex_article(spark, d):
    """Article records of pages."""
    return S.articles(T.table(spark, d, "pages"), "page_id")


@query("dom_signature")
def dom_signature(spark, d):
    """A hash of a page's distinct tags with their sorted classes; the set comes from a parser, the hash is native."""
    return S.dom_signatures(T.table(spark, d, "pages"), "page_id")


@query("cache_key")
def cache_key(spark, d):
    """domain:pattern:signature of pages."""
    from pagelathe.functions import urls as U

    pages = T.table(spark, d, "pages")
    key = pages.select("page_id", U.domain(F.col("url")).alias("domain"), U.path_pattern(U.path(F.col("url")), last_slug=False).alias("pattern"))
    return S.dom_signatures(pages, "page_id").join(key, "page_id").select("page_id", F.concat_ws(":", "domain", "pattern", "signature").alias("cache_key"))


@query("ex_cascade")
def ex_cascade(spark, d):
    """All deterministic tiers over product pages: structured data, selectors, patterns; then merged."""
    from pagelathe.operators.cascade import extract

    return extract(T.product_pages(spark, d), "page_id")


@query("json_fence", "WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '```json' || chr(10) || '[{\"field\":\"title\",\"selector\":\"h' || CAST(p_partkey AS STRING) || '\"}]' || chr(10) || '```' WHEN 1 THEN 'Sure: [{\"field\":\"price\",\"selector\":\".p\"}] done' ELSE 'no rules' END AS t FROM part) SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'price' END AS field, CASE p_partkey % 3 WHEN 0 THEN 'h' || CAST(p_partkey AS STRING) WHEN 1 THEN '.p' END AS selector FROM r WHERE p_partkey % 3 < 2")
def json_fence(spark, d):
    """Rules in a model's answer: fences stripped, else the first bracketed part; entries without their keys dropped."""
    answer = F.expr("CASE p_partkey % 3 WHEN 0 THEN '```json\n[{\"field\":\"title\",\"selector\":\"h' || CAST(p_partkey AS STRING) || '\"}]\n```' WHEN 1 THEN 'Sure: [{\"field\":\"price\",\"selector\":\".p\"}] done' ELSE 'no rules' END")
    plain = F.regexp_replace(answer, r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", "")
    part = F.regexp_extract(answer, r"(?s)(\[.*\]|\{.*\})", 1)
    kind = "array<struct<field:string,selector:string>>"
    rules = F.coalesce(*(F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, kind)) for x in (plain, part)))
    rules = F.filter(rules, lambda r: r["field"].isNotNull() & r["selector"].isNotNull())
    return T.table(spark, d, "part").select("p_partkey", F.inline(rules))


@query("udtf_links", """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS l FROM pages) SELECT page_id, CAST(unnest(range(0, len(l))) AS INT) AS position, unnest(l) AS href FROM l""")
def udtf_links(spark, d):
    """Links of pages by a table function in SQL."""
    from pagelathe.functions import udtf

    udtf.register(spark)
    return spark.sql("SELECT page_id, l.position, l.href FROM {p}, LATERAL html_links(html) l", p=T.table(spark, d, "pages"))
