"""URL, string and hash projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelathe.functions import urls as U
from pagelathe.plans.registry import query
from pagelathe.sources import tables as T

_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))"
_PATH = "regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
_U = f"u AS ({T.URLS}), p AS (SELECT id, url, {_HOST} AS host, {_PATH} AS path, regexp_replace(lower({_PATH}), '/$', '') || '/' AS slashed FROM u)"
_CLASS = f"CASE WHEN regexp_matches(slashed, '{U.alternation(U.PRODUCT)}') THEN 'product' WHEN regexp_matches(slashed, '{U.alternation(U.CATEGORY)}') THEN 'category' WHEN regexp_matches(slashed, '{U.alternation(U.LOW_VALUE)}') THEN 'low_value' ELSE 'unknown' END"
_VALUE = "CASE " + " ".join(f"WHEN contains(host, '{d}') THEN {v}::DOUBLE" for d, v in U.DOMAIN_VALUE.items()) + " ELSE 0.0 END"
_SCORE = f"least(100, greatest(0, trunc(CASE {_CLASS} WHEN 'product' THEN 85.0::DOUBLE WHEN 'category' THEN 60.0 WHEN 'low_value' THEN 5.0 ELSE 30.0 END + ({_VALUE}) * 10)::INT))"
_TOPIC = f"CASE WHEN {_SCORE} >= 70 THEN 'high' WHEN {_SCORE} >= 30 THEN 'normal' ELSE 'low' END"


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(url), '{w}')" for w in words) + ")"


def segments(path: str = "path", last_slug: bool = True) -> str:
    """SQL of a path's pattern; last_slug also replaces a plain last segment."""
    parts = f"string_split(regexp_replace({path}, '^/+|/+$', '', 'g'), '/')"
    last = f"WHEN i = len({parts}) AND regexp_matches(s, '^[A-Za-z0-9_-]+$') THEN '{{slug}}'" if last_slug else ""
    return f"""'/' || array_to_string(list_transform({parts}, lambda s, i:
        CASE WHEN regexp_matches(s, '^[A-Z0-9]{{8,}}$') THEN '{{sku}}' WHEN regexp_matches(s, '^[a-z0-9]+-[a-z0-9-]+$') THEN '{{slug}}'
             WHEN regexp_matches(s, '^[0-9]+$') THEN '{{id}}' {last} ELSE s END), '/')"""


def _each(name: str, column: str, build, sql: str) -> None:
    """A query of id and one computed column over all URLs."""
    query(name, f"WITH {_U} SELECT id, {sql} AS {column} FROM p")(lambda spark, d: T.urls(spark, d).select("id", build(F.col("url")).alias(column)))


_each("url_domain", "domain", U.domain, f"coalesce(nullif({_HOST}, ''), 'unknown')")
_each("url_path", "path", U.path, "path")
_each("url_class", "url_class", U.url_class, _CLASS)
_each("url_score", "score", U.url_score, _SCORE)
_each("url_topic", "topic", lambda u: U.url_topic(U.url_score(u)), _TOPIC)
_each("url_pattern", "pattern", lambda u: U.path_pattern(U.path(u)), segments())
_each("url_pattern_cache", "pattern", lambda u: U.path_pattern(U.path(u), last_slug=False), segments(last_slug=False))
_each("url_ttl", "ttl", U.url_ttl, f"CASE WHEN {_has(U.TTL_PRODUCT)} THEN 3600 WHEN {_has(U.TTL_LISTING)} THEN 21600 WHEN {_has(U.TTL_ARTICLE)} THEN 86400 ELSE 3600 END")
_each("url_is_article", "is_article", U.is_article, _has(U.ARTICLE))
_each("url_dedup_key", "key", U.dedup_key, "left(sha256(url), 16)")
_each("jn_domain_val", "domain_value", U.domain_value, _VALUE)


@query("flagship_topics", f"WITH {_U} SELECT {_TOPIC} AS topic, {_CLASS} AS url_class, count(*) AS n, round(avg({_SCORE}), 6) AS avg_score FROM p GROUP BY 1, 2")
def flagship_topics(spark, d):
    """URLs by queue topic and class, with their mean score."""
    scored = T.urls(spark, d).select(U.url_class(F.col("url")).alias("url_class"), U.url_score(F.col("url")).alias("score"))
    return scored.groupBy(U.url_topic(F.col("score")).alias("topic"), "url_class").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


@query("url_score_recency", f"WITH {_U}, o AS (SELECT o_orderkey, 'https://walmart.com/product/' || CAST(o_orderkey AS STRING) AS url, o_orderkey % 200 AS hours FROM orders) SELECT o_orderkey AS id, least(100, greatest(0, trunc(85.0::DOUBLE + 9.0 + least(5.0::DOUBLE, hours / 24.0::DOUBLE))::INT)) AS score FROM o")
def url_score_recency(spark, d):
    """Scores with the hours since the last visit."""
    o = T.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("https://walmart.com/product/"), F.col("o_orderkey").cast("string")).alias("url"), (F.col("o_orderkey") % 200).alias("hours"))
    return o.select(F.col("o_orderkey").alias("id"), U.url_score(F.col("url"), recency_hours=F.col("hours")).alias("score"))


@query("url_match", f"WITH {_U}, r AS ({T.RULES}), m AS (SELECT DISTINCT path_pattern, '^' || replace(replace(replace(replace(replace(regexp_replace(path_pattern, '([.+?^$()|])', '\\\\\\1', 'g'), '{{id}}', '[^/]+'), '{{sku}}', '[^/]+'), '{{slug}}', '[^/]+'), '{{category}}', '[^/]+'), '*', '[^/]*') AS re FROM r) SELECT id, path_pattern FROM p, m WHERE regexp_matches(path, re)")
def url_match(spark, d):
    """Every URL with each rule pattern that its path begins with."""
    from pagelathe.operators.rules import matching

    patterns = T.rules(spark, d).select("path_pattern").distinct()
    return matching(T.urls(spark, d).select("id", U.path(F.col("url")).alias("path")), patterns).select("id", "path_pattern")


@query("rule_key", f"WITH r AS ({T.RULES}) SELECT rule_id, 'extract:rule:' || domain || ':' || left(md5(path_pattern), 12) AS rule_key FROM r")
def rule_key(spark, d):
    return T.rules(spark, d).select("rule_id", F.concat_ws(":", F.lit("extract"), F.lit("rule"), "domain", F.substring(F.md5("path_pattern"), 1, 12)).alias("rule_key"))


@query("engine_key", f"WITH u AS ({T.URLS}) SELECT id, CAST(CAST('0x' || left(md5(string_split(url, '?')[1]), 8) AS BIGINT) % 100000 AS BIGINT) AS bucket FROM u")
def engine_key(spark, d):
    """A stable bucket of each URL without its query."""
    return T.urls(spark, d).select("id", U.engine_bucket(F.col("url")).alias("bucket"))


@query("hash_fp", "SELECT s_suppkey, left(sha256(s_name || ':' || CAST(s_nationkey AS STRING)), 32) AS h FROM supplier")
def hash_fp(spark, d):
    """A composite key's hash."""
    return T.table(spark, d, "supplier").select("s_suppkey", F.substring(F.sha2(F.concat_ws(":", "s_name", F.col("s_nationkey").cast("string")), 256), 1, 32).alias("h"))


@query("hash_ja", "SELECT l_orderkey, md5(array_to_string(list(l_linenumber ORDER BY l_linenumber), '-')) AS list_hash, CAST(bit_xor(l_linenumber) AS BIGINT) AS list_xor FROM lineitem GROUP BY l_orderkey")
def hash_ja(spark, d):
    """Hash and exclusive-or of an order's line numbers as a list."""
    return T.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.md5(F.array_join(F.array_sort(F.collect_list("l_linenumber")), "-")).alias("list_hash"), F.bit_xor("l_linenumber").cast("long").alias("list_xor"))


# Renderer families by substring.
GPU = [("nvidia", "nvidia"), ("geforce", "nvidia"), ("amd", "amd"), ("radeon", "amd"), ("intel", "intel"), ("apple", "apple")]


@query("gpu_family", "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(r), '{k}') THEN '{v}'" for k, v in GPU) + " ELSE 'unknown' END AS family FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'NVIDIA GeForce' WHEN 1 THEN 'AMD Radeon Pro' WHEN 2 THEN 'Intel Iris' WHEN 3 THEN 'Apple M1' ELSE 'Other' END AS r FROM part)")
def gpu_family(spark, d):
    """Substring classification of a renderer name."""
    r = T.table(spark, d, "part").select("p_partkey", F.expr("CASE p_partkey % 5 WHEN 0 THEN 'NVIDIA GeForce' WHEN 1 THEN 'AMD Radeon Pro' WHEN 2 THEN 'Intel Iris' WHEN 3 THEN 'Apple M1' ELSE 'Other' END").alias("r"))
    family = F
    for k, v in GPU:
        family = family.when(F.contains(F.lower("r"), F.lit(k)), v)
    return r.select("p_partkey", family.otherwise("unknown").alias("family"))


@query("set_dedup", f"WITH u AS ({T.URLS}) SELECT trim(url) AS url, min(id) AS first_id FROM u GROUP BY 1")
def set_dedup(spark, d):
    """Distinct URLs in the order of their first appearance, which the smallest id gives; no task sees all rows."""
    return T.urls(spark, d).groupBy(F.trim("url").alias("url")).agg(F.min("id").alias("first_id"))


@query("set_union", f"WITH u AS ({T.URLS}) SELECT url FROM u WHERE id LIKE 'page-%' UNION ALL SELECT url FROM u WHERE id LIKE 'part-%' UNION ALL SELECT url FROM u WHERE id LIKE 'nation-%'")
def set_union(spark, d):
    """URLs given in several ways, one after the other, with repeats."""
    u = T.urls(spark, d)
    part = lambda p: u.where(F.col("id").like(p)).select("url")
    return part("page-%").unionByName(part("part-%")).unionByName(part("nation-%"))


@query("src_url_text", f"WITH u AS ({T.URLS}) SELECT trim(x) AS url FROM (SELECT unnest([' ' || url || ' ', '', '# note']) AS x FROM u) WHERE starts_with(trim(x), 'http')")
def src_url_text(spark, d):
    """Lines of a URL list: trimmed, blank lines and those that are no http URL dropped."""
    from pagelathe.sources.text import url_lines

    u = T.urls(spark, d).select(F.explode(F.array(F.concat(F.lit(" "), "url", F.lit(" ")), F.lit(""), F.lit("# note"))).alias("value"))
    return url_lines(u)


@query("src_url_csv", f"WITH u AS ({T.URLS}) SELECT url || ',x' AS url FROM u WHERE starts_with(url, 'http')")
def src_url_csv(spark, d):
    """A .csv list is read as raw lines, commas and all."""
    from pagelathe.sources.text import url_lines

    return url_lines(T.urls(spark, d).select(F.concat("url", F.lit(",x")).alias("value")))


@query("src_clipboard", f"WITH u AS ({T.URLS}) SELECT id, unnest(regexp_extract_all('see ' || url || ' and ' || url, 'https?://[^\\s]+')) AS url FROM u")
def src_clipboard(spark, d):
    """URLs found in pasted text."""
    from pagelathe.sources.text import found_urls

    return T.urls(spark, d).select("id", F.explode(found_urls(F.concat(F.lit("see "), "url", F.lit(" and "), "url"))).alias("url"))
