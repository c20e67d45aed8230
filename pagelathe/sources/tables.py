"""Table loading, and relations derived from the tables by SQL that both Spark and DuckDB run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without a zone are taken as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


#: Fetch attempts, relabelled from events.
FETCH_LOG = """
SELECT event_id, ts, 'd' || CAST(user_id % 20 AS STRING) AS domain, 'p' || CAST(user_id % 10 AS STRING) AS proxy_id,
       CASE k % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'playwright' WHEN 2 THEN 'lightpanda' ELSE 'nodriver' END AS engine,
       CASE WHEN event_type IN ('click', 'view') THEN 200 WHEN event_type = 'purchase' THEN 302
            WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 503 ELSE 429 END
            ELSE CASE WHEN k % 3 = 0 THEN 403 WHEN k % 3 = 1 THEN 404 ELSE 500 END END AS status_code,
       CASE WHEN event_type = 'signup' AND k % 4 = 0 THEN 'cloudflare' WHEN event_type = 'signup' AND k % 4 = 2 THEN 'datadome'
            WHEN event_type = 'error' AND k % 3 = 0 AND k % 2 = 0 THEN 'captcha' ELSE '' END AS challenge_type,
       value * 100 AS latency_ms, user_id, k
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""

#: URLs of every class: those of pages, and made ones from part and nation.
URLS = """
SELECT 'page-' || CAST(page_id AS STRING) AS id, url FROM pages
UNION ALL
SELECT 'part-' || CAST(p_partkey AS STRING) AS id,
       CASE p_partkey % 12
         WHEN 0 THEN 'https://www.Amazon.com/dp/B00' || lpad(CAST(p_partkey AS STRING), 7, '0')
         WHEN 1 THEN 'https://walmart.com/product/red-shirt-' || CAST(p_partkey AS STRING)
         WHEN 2 THEN 'http://m.example.com/category/shoes/' || CAST(p_partkey AS STRING)
         WHEN 3 THEN 'https://shop.example.org/cart?item=' || CAST(p_partkey AS STRING)
         WHEN 4 THEN 'https://ebay.com/item/' || CAST(p_partkey AS STRING) || '/'
         WHEN 5 THEN 'https://news.example.net/article/' || CAST(p_partkey AS STRING) || '.html'
         WHEN 6 THEN 'https://example.com/search/?q=' || CAST(p_partkey AS STRING)
         WHEN 7 THEN 'https://etsy.com/shop/abc-' || CAST(p_partkey AS STRING) || '#top'
         WHEN 8 THEN 'https://example.com/random-page'
         WHEN 9 THEN 'https://example.com/login/' || CAST(p_partkey AS STRING)
         WHEN 10 THEN 'https://mp.example.com/s?id=' || CAST(p_partkey AS STRING)
         ELSE 'https://Target.com:8443/Products/' || CAST(p_partkey AS STRING) || '?a=b' END AS url
FROM part
UNION ALL
SELECT 'nation-' || CAST(n_nationkey AS STRING) AS id, 'https://www.example.com/collections/' || lower(n_name) AS url FROM nation
"""

#: Product pages with JSON-LD and visible text, made from part. Some have a graph, some break the JSON.
PRODUCT_PAGES = """
SELECT p_partkey AS page_id, 'https://shop' || CAST(p_partkey % 7 AS STRING) || '.example.com/product/' || CAST(p_partkey AS STRING) AS url,
  '<html><head><title>' || p_name || '</title><script type="application/ld+json">' ||
  CASE p_partkey % 5
    WHEN 0 THEN '{"@type":"Product","name":"' || p_name || '","sku":"SKU-' || CAST(p_partkey AS STRING) || '","brand":{"@type":"Brand","name":"' || p_brand || '"},"offers":{"@type":"Offer","price":"' || CAST(p_partkey AS STRING) || '.50","priceCurrency":"EUR"}}'
    WHEN 1 THEN '{"@graph":[{"@type":"Organization","name":"Org' || CAST(p_partkey % 3 AS STRING) || '"},{"@type":["Product","Thing"],"name":"' || p_name || '","image":["a.png","b.png"],"aggregateRating":{"ratingValue":"4.5","reviewCount":"17"}}]}'
    WHEN 2 THEN '{"@type":"Product","name":'
    WHEN 3 THEN '{"@type":"Offer","price":"' || CAST(p_partkey AS STRING) || '","availability":"InStock"}'
    ELSE '{"@type":"WebSite","name":"no product"}' END ||
  '</script></head><body><h1>' || p_name || '</h1><p>Price: $' || CAST(p_partkey % 900 AS STRING) || '.99 SKU: AB-' || CAST(10000 + p_partkey AS STRING) ||
  ' rated 4.' || CAST(p_partkey % 10 AS STRING) || ' out of 5, ' || CAST(p_partkey % 500 AS STRING) || ' reviews</p><a href="/product/' || CAST(p_partkey + 1 AS STRING) || '">next</a></body></html>' AS html
FROM part
"""

#: Extraction rules of the fetch and URL domains.
RULES = """
SELECT 'r1' AS rule_id, 'example.com' AS domain, '/search/*' AS path_pattern, 'title' AS field_name
UNION ALL SELECT 'r2', 'ebay.com', '/item/{id}', 'price'
UNION ALL SELECT 'r3', 'ebay.com', '/item/{id}', 'title'
UNION ALL SELECT 'r4', 'ebay.com', '/item/*', 'brand'
UNION ALL SELECT 'r5', 'walmart.com', '/product/{slug}', 'price'
UNION ALL SELECT 'r6', 'www.amazon.com', '/dp/{sku}', 'title'
UNION ALL SELECT 'r7', 'etsy.com', '/shop/{slug}', 'title'
UNION ALL SELECT 'r8', 'example.com', '/login', 'title'
"""


def relation(spark: SparkSession, sf_dir: str, sql: str, rows: int | None = None) -> DataFrame:
    """A relation of this module from the tables in sf_dir, by one of the SQL texts above.

    With rows, tables are dealt out in parts of about so many rows before anything is computed from them: a narrow table of
    millions of rows is one file of few row groups, and what is derived from a row may cost much more than reading it.
    """
    names = ["events", "pages", "part", "nation", "orders", "lineitem", "supplier", "customer", "documents", "labels"]
    used = [n for n in names if f"FROM {n}" in sql]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in used:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    tables = {n: table(spark, sf_dir, n) for n in used}
    if rows:
        tables = {n: t.repartition(max(1, -(-t.count() // rows))) for n, t in tables.items()}
    return spark.sql(sql, **tables)


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, FETCH_LOG)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, URLS)


def product_pages(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    return relation(spark, sf_dir, PRODUCT_PAGES, rows)


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RULES)
