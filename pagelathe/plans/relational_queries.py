"""Lookups, joins, paging, changes and exports of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelathe.functions import urls as U
from pagelathe.operators import tables as O
from pagelathe.plans.registry import query
from pagelathe.sources import blobs, messages
from pagelathe.sources import tables as T
from pagelathe.sources.keyed import KeyedTable
from pagelathe.streaming.sources import shared_dir


def _orders(spark, d):
    return T.table(spark, d, "orders")


@query("src_pg_get", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")
def src_pg_get(spark, d):
    return O.get(_orders(spark, d).select("o_orderkey", "o_custkey"), o_orderkey=7)


@query("src_pg_all", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def src_pg_all(spark, d):
    return O.page(_orders(spark, d), [F.desc("o_totalprice"), F.col("o_orderkey")], 50, 10, o_orderstatus="O").select("o_orderkey", "o_totalprice")


@query("src_mongo_find", "SELECT o_orderkey FROM orders WHERE o_custkey = 22 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def src_mongo_find(spark, d):
    return O.page(_orders(spark, d), [F.desc("o_orderdate"), F.col("o_orderkey")], 100, o_custkey=22).select("o_orderkey")


@query("topk_pending", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderkey LIMIT 200")
def topk_pending(spark, d):
    return O.page(_orders(spark, d), [F.col("o_orderpriority"), F.col("o_orderkey")], 200, o_orderstatus="P").select("o_orderkey")


@query("page_tasks", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderpriority = '5-LOW') AS total FROM orders WHERE o_orderpriority = '5-LOW' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_tasks(spark, d):
    """A page of tasks with the total; the count is an aggregation of its own, not a window over all rows."""
    o = _orders(spark, d)
    total = O.matching(o, o_orderpriority="5-LOW").agg(F.count("*").alias("total"))
    return O.page(o, [F.desc("o_orderdate"), F.col("o_orderkey")], 50, 100, o_orderpriority="5-LOW").select("o_orderkey").join(F.broadcast(total))


@query("topk_identity", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 50")
def topk_identity(spark, d):
    return O.page(T.table(spark, d, "supplier"), [F.desc("s_acctbal"), F.col("s_suppkey")], 50).select("s_suppkey")


@query("task_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 10")
def task_filter(spark, d):
    return O.matching(_orders(spark, d), o_orderstatus="F", o_custkey=10, o_orderpriority=None).select("o_orderkey")


@query("proxy_active", "SELECT s_suppkey FROM (SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 100) WHERE s_acctbal / 10000 >= 0.3 AND s_suppkey % 10 < 5 ORDER BY s_acctbal DESC, s_suppkey LIMIT 50")
def proxy_active(spark, d):
    """Filters on the best hundred only, as documented for this lookup; then the best fifty of those."""
    top = O.page(T.table(spark, d, "supplier"), [F.desc("s_acctbal"), F.col("s_suppkey")], 100)
    good = top.where((F.col("s_acctbal") / 10000 >= 0.3) & (F.col("s_suppkey") % 10 < 5))
    return O.page(good, [F.desc("s_acctbal"), F.col("s_suppkey")], 50).select("s_suppkey")


@query("jn_task_result", "SELECT o_orderkey, count(l_linenumber) AS results, coalesce(round(sum(l_extendedprice), 2), 0) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def jn_task_result(spark, d):
    """Tasks with their results. Results are summed by key before the join, so one shuffle serves both."""
    lines = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("results"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return _orders(spark, d).select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("results", F.lit(0)).cast("long").alias("results"), F.coalesce("total", F.lit(0.0)).alias("total"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_RE = "'^' || replace(replace(replace(replace(regexp_replace(path_pattern, '([.+?^$()|])', '\\\\\\1', 'g'), '{id}', '[^/]+'), '{sku}', '[^/]+'), '{slug}', '[^/]+'), '*', '[^/]*')"
_RULES = f"u AS ({T.URLS}), p AS (SELECT id, {_HOST} AS host, {_PATH} AS path FROM u), r AS (SELECT *, {_RE} AS re FROM ({T.RULES}))"


@query("jn_rules", f"WITH {_RULES} SELECT id, string_agg(rule_id, ',' ORDER BY path_pattern, rule_id) AS rules FROM p JOIN r ON host = domain AND regexp_matches(path, re) GROUP BY id")
def jn_rules(spark, d):
    """The rules of every URL, by domain and path."""
    from pagelathe.operators.rules import rules_for

    found = rules_for(T.urls(spark, d), T.rules(spark, d))
    return found.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path_pattern", "rule_id"))), lambda x: x["rule_id"]), ",").alias("rules"))


@query("jn_has_rules", f"WITH {_RULES} SELECT id FROM p WHERE EXISTS (SELECT 1 FROM r WHERE host = domain AND regexp_matches(path, re))")
def jn_has_rules(spark, d):
    from pagelathe.operators.rules import rules_for

    return rules_for(T.urls(spark, d), T.rules(spark, d), how="left_semi").select("id")


@query("jn_proxy", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def jn_proxy(spark, d):
    """Ids by score, looked up in the details."""
    s = T.table(spark, d, "supplier")
    return s.where("s_acctbal > 0").select("s_suppkey").join(s.select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey")


@query("jn_cache", "WITH c AS (SELECT event_id, user_id AS key, ts, ts + INTERVAL 6 HOUR AS expires_at FROM events WHERE event_type = 'signup'), q AS (SELECT event_id, user_id AS key, ts FROM events WHERE event_type = 'purchase') SELECT q.event_id, max(c.event_id) AS hit FROM q LEFT JOIN c ON c.key = q.key AND c.ts <= q.ts AND c.expires_at > q.ts GROUP BY q.event_id")
def jn_cache(spark, d):
    """The cache entry that is valid at a request's time: the last one of its key that has not expired."""
    from pagelathe.operators.asof import as_of

    e = T.table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), "ts", "event_type")
    entries = e.where("event_type = 'signup'").select("key", "ts", F.col("event_id").alias("hit"))
    asked = e.where("event_type = 'purchase'").select("event_id", "key", "ts")
    return as_of(asked, entries, "key", "ts", ["hit"], seconds=6 * 3600).select("event_id", "hit")


@query("jn_engine", f"WITH f AS ({T.FETCH_LOG}), c AS (SELECT * FROM f WHERE status_code = 200), m AS (SELECT f.event_id, arg_max(c.engine, c.event_id) AS engine FROM f LEFT JOIN c ON c.user_id = f.user_id AND c.event_id < f.event_id AND c.ts > f.ts - INTERVAL 10 HOUR GROUP BY f.event_id) SELECT event_id, array_to_string(list_prepend(engine, list_filter(['http', 'playwright', 'lightpanda', 'nodriver'], lambda e: e <> coalesce(engine, ''))), ',') AS engines FROM m")
def jn_engine(spark, d):
    """Engines in order, the one that last succeeded for the same key first."""
    from pagelathe.operators.scans import scan

    log = T.fetch_log(spark, d).select("event_id", "user_id", "ts", "engine", "status_code")
    f = scan(log, "user_id", "ts", ["event_id"], x=F.when(F.col("status_code") == 200, F.struct("engine", "ts")))
    near = F.unix_micros("ts") - F.unix_micros("x.ts") < 36_000_000_000
    default = F.array(*map(F.lit, ["http", "playwright", "lightpanda", "nodriver"]))
    order = F.when(near, F.array_union(F.array("x.engine"), default)).otherwise(default)
    return f.select("event_id", F.array_join(order, ",").alias("engines"))


@query("jn_tz", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jn_tz(spark, d):
    """Country and continent of a customer, by two small lookups."""
    c = T.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = T.table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return c.join(n, "n_nationkey").join(T.table(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey").select("c_custkey", "n_name", "r_name")


@query("src_geo", "SELECT s_suppkey, CASE n_name WHEN 'GERMANY' THEN 'Europe/Berlin' WHEN 'JAPAN' THEN 'Asia/Tokyo' WHEN 'FRANCE' THEN 'Europe/Paris' ELSE 'UTC' END AS zone FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def src_geo(spark, d):
    """A time zone by country; without one UTC."""
    zones = F.create_map(*(F.lit(x) for kv in {"GERMANY": "Europe/Berlin", "JAPAN": "Asia/Tokyo", "FRANCE": "Europe/Paris"}.items() for x in kv))
    s = T.table(spark, d, "supplier").join(T.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", F.coalesce(F.try_element_at(zones, "n_name"), F.lit("UTC")).alias("zone"))


def _keyed(spark, df, key: str) -> KeyedTable:
    return KeyedTable.create(df, f"{shared_dir(spark)}/pagelathe/table-{uuid.uuid4().hex}", key, buckets=8)


@query("snk_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus = 'P' AS changed FROM orders")
def snk_update(spark, d):
    """A stored table after its pending rows have been set."""
    o = _orders(spark, d).select("o_orderkey", "o_orderstatus", (F.col("o_orderstatus") == "P").alias("changed"))
    stored = _keyed(spark, o, "o_orderkey")
    stored.update(F.col("o_orderstatus") == "P", {"o_orderstatus": F.lit("O")})
    return stored.read()


@query("snk_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def snk_delete(spark, d):
    """A stored table of results once those of finished tasks are deleted."""
    gone = _orders(spark, d).where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    stored = _keyed(spark, T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")
    stored.delete(gone)
    return stored.read()


@query("snk_upsert", "WITH n AS (SELECT p_partkey + 1000 AS p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'new ' || p_name END AS p_name, p_size FROM part WHERE p_partkey % 3 = 0) SELECT coalesce(n.p_partkey, p.p_partkey) AS p_partkey, coalesce(n.p_name, p.p_name) AS p_name, p_brand, coalesce(n.p_size, p.p_size) AS p_size FROM part p FULL OUTER JOIN n ON p.p_partkey = n.p_partkey")
def snk_upsert(spark, d):
    """A stored table after new rows have been merged into it."""
    p = T.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    new = p.where("p_partkey % 3 = 0").select((F.col("p_partkey") + 1000).alias("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("new "), "p_name")).alias("p_name"), "p_size")
    stored = _keyed(spark, p, "p_partkey")
    stored.upsert(new)
    return stored.read()


@query("st_rulecache", f"WITH r AS ({T.RULES}) SELECT rule_id, domain FROM r WHERE domain <> 'ebay.com' UNION ALL SELECT 'n1', 'ebay.com'")
def st_rulecache(spark, d):
    """A rule cache after a domain's rules have been replaced."""
    rules = T.rules(spark, d).select("rule_id", "domain")
    return O.put(rules, spark.sql("SELECT 'n1' AS rule_id, 'ebay.com' AS domain"), "domain")


@query("src_kv_file", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 48 HOUR")
def src_kv_file(spark, d):
    """Cache entries younger than two days at the time of the newest."""
    e = T.table(spark, d, "events").select("event_id", "ts")
    now = e.agg(F.max("ts").alias("now"))
    cache = e.withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 48 HOUR")).join(F.broadcast(now))
    return O.valid_at(cache, F.col("now")).select("event_id")


@query("snk_json_export", """SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS line FROM orders WHERE o_orderstatus = 'F'""")
def snk_json_export(spark, d):
    """Finished records as JSON lines; the caller pages them if it wants fewer."""
    return _orders(spark, d).where("o_orderstatus = 'F'").select(messages.serialize("o_orderkey", "o_orderstatus").alias("line"))


@query("json_serde", "SELECT o_orderkey AS task_id, 'https://x.example/' || o_orderkey AS url, CAST(o_custkey % 100 AS INT) AS priority FROM orders")
def json_serde(spark, d):
    """Tasks written as JSON and parsed again; broken messages among them are skipped."""
    o = _orders(spark, d).select(F.col("o_orderkey").cast("string").alias("task_id"), F.concat(F.lit("https://x.example/"), F.col("o_orderkey").cast("string")).alias("url"), (F.col("o_custkey") % 100).cast("int").alias("priority"))
    wire = o.select(messages.serialize("task_id", "url", "priority").alias("value")).unionByName(o.limit(3).select(F.lit("{broken").alias("value")))
    return messages.good(wire, messages.TASK).select(F.col("task_id").cast("long").alias("task_id"), "url", "priority")


@query("payload_build", """SELECT o_orderkey, '{"task_id":"' || o_orderkey || '","s3_bucket":"b","s3_raw_html_key":"k/' || o_orderkey || '","extraction_rules":[],"callback_topic":"results"}' AS payload, true AS fits FROM orders""")
def payload_build(spark, d):
    key = F.col("o_orderkey").cast("string")
    p = messages.payload(key, F.lit("b"), F.concat(F.lit("k/"), key))
    return _orders(spark, d).select("o_orderkey", p.alias("payload"), messages.fits(p).alias("fits"))


@query("compress_ratio", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity = 0 THEN 0 ELSE (1 - l_linenumber / l_quantity) * 100 END, 6) AS ratio FROM lineitem")
def compress_ratio(spark, d):
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(blobs.compression_ratio(F.col("l_quantity"), F.col("l_linenumber")), 6).alias("ratio"))


@query("compress", "SELECT page_id, codec, strlen(html) AS n_bytes, sha256(html) AS digest FROM pages, (VALUES ('gzip'), ('zstd')) c(codec)")
def compress(spark, d):
    """Pages packed and unpacked again by each codec: their size and hash after the round trip."""
    p = T.table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("raw"))
    packed = p.select("page_id", F.explode(F.create_map(F.lit("gzip"), blobs.pack_gzip("raw"), F.lit("zstd"), blobs.pack_zstd("raw"))).alias("codec", "packed"))
    back = packed.select("page_id", "codec", blobs.unpack("packed").alias("raw"))
    return back.select("page_id", "codec", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("digest"))


@query("snk_s3_html", "SELECT page_id, strlen(html) AS original, true AS smaller FROM pages")
def snk_s3_html(spark, d):
    """Stored pages with their sizes."""
    p = T.table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("raw"))
    return p.select("page_id", F.octet_length("raw").cast("long").alias("original"), (F.octet_length(blobs.pack_gzip("raw")) < F.octet_length("raw")).alias("smaller"))


@query("accept_lang", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'en-US,en;q=0.9' WHEN 1 THEN 'de-DE,de;q=0.9,en;q=0.8' ELSE 'fr-FR' END AS header FROM nation")
def accept_lang(spark, d):
    """The language header that a record's locale and languages would give, for consistency checks."""
    from pagelathe.functions.text import language_header

    n = T.table(spark, d, "nation")
    locale = F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'en-US' WHEN 1 THEN 'de-DE' ELSE 'fr-FR' END")
    languages = F.expr("CASE n_nationkey % 3 WHEN 0 THEN array('en-US', 'en') WHEN 1 THEN array('de-DE', 'de', 'en') ELSE array('fr-FR') END")
    return n.select("n_nationkey", language_header(locale, languages).alias("header"))


@query("snk_batch", "SELECT o_orderkey, true AS fits FROM orders")
def snk_batch(spark, d):
    """Rows written and read back in insert batches; fits tells whether a row's batch has at most twenty."""
    b = O.batch_numbers(_orders(spark, d).select("o_orderkey"), "o_orderkey", 20)
    path = f"{shared_dir(spark)}/pagelathe/batches-{uuid.uuid4().hex}"
    b.write.parquet(path)
    stored = spark.read.schema(b.schema).parquet(path)
    sizes = stored.groupBy("bucket", "batch").agg((F.count("*") <= 20).alias("fits"))
    return stored.join(sizes, ["bucket", "batch"]).select("o_orderkey", "fits")


@query("snk_prom", f"WITH f AS ({T.FETCH_LOG}) SELECT 'requests_total' AS name, 'domain=' || domain || ',engine=' || engine AS labels, count(*)::DOUBLE AS value FROM f GROUP BY domain, engine")
def snk_prom(spark, d):
    """Metrics in long form: name, labels, value."""
    f = T.fetch_log(spark, d).groupBy("domain", "engine").count()
    return f.select(F.lit("requests_total").alias("name"), F.concat(F.lit("domain="), "domain", F.lit(",engine="), "engine").alias("labels"), F.col("count").cast("double").alias("value"))


@query("snk_statefile", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def snk_statefile(spark, d):
    """Entries of a batch that are still to be done."""
    o = _orders(spark, d).select("o_orderkey", "o_orderstatus")
    return O.delete(o, o.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey").select("o_orderkey")


@query("sm_proxy_crud", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN 'banned' ELSE 'active' END AS status FROM supplier WHERE s_suppkey % 4 <> 0")
def sm_proxy_crud(spark, d):
    """A pool after some entries were removed and some banned."""
    s = T.table(spark, d, "supplier").select("s_suppkey", F.lit("active").alias("status"))
    left = O.delete(s, s.where("s_suppkey % 4 = 0").select("s_suppkey"), "s_suppkey")
    return O.update_where(left, F.col("s_suppkey") % 4 == 1, {"status": F.lit("banned")})
