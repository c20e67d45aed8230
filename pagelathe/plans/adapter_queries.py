"""Sources, sinks and hooks that stand in for outside services: each writes to the shared folder and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelathe.functions import urls as U
from pagelathe.operators import folds
from pagelathe.operators.cascade import extract, extract_and_heal
from pagelathe.operators.model_tiers import read_screenshots
from pagelathe.operators.selectors import RULES
from pagelathe.plans.fold_queries import LOOP
from pagelathe.plans.registry import query
from pagelathe.sources import blobs, messages
from pagelathe.sources import tables as T
from pagelathe.streaming.sources import new_folder, run_available, shared_dir

#: Rows of a narrow table that a task makes pages of and parses.
PARSED = 10_000


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/pagelathe/{name}-{uuid.uuid4().hex}"


def _tasks(spark, d):
    """Order rows as tasks with a topic."""
    o = T.table(spark, d, "orders")
    topic = F.when(F.col("o_orderpriority") < "2", "high").when(F.col("o_orderpriority") < "4", "normal").otherwise("low")
    return o.select(F.col("o_orderkey").cast("string").alias("task_id"), F.concat(F.lit("https://x.example/"), F.col("o_orderkey").cast("string")).alias("url"), topic.alias("topic"))


_TASKS = "SELECT CAST(o_orderkey AS STRING) AS task_id, 'https://x.example/' || CAST(o_orderkey AS STRING) AS url FROM orders"


@query("snk_insert", _TASKS)
def snk_insert(spark, d):
    """Rows appended to a table in two writes."""
    path, t = _path(spark, "insert"), _tasks(spark, d).select("task_id", "url")
    even = F.col("task_id").cast("long") % 2 == 0
    for part in (t.where(even), t.where(~even)):
        part.write.mode("append").parquet(path)
    return spark.read.schema(t.schema).parquet(path)


@query("snk_mongo_insert", _TASKS)
def snk_mongo_insert(spark, d):
    """Documents as JSON lines, dealt into buckets of their key."""
    path, t = _path(spark, "documents"), _tasks(spark, d).select("task_id", "url")
    t.withColumn("bucket", F.pmod(F.xxhash64("task_id"), F.lit(8))).write.partitionBy("bucket").json(path)
    return spark.read.schema("task_id string, url string").json(path).select("task_id", "url")


@query("snk_kafka", """SELECT CASE WHEN o_orderpriority < '2' THEN 'high' WHEN o_orderpriority < '4' THEN 'normal' ELSE 'low' END AS topic, '{"task_id":"' || o_orderkey || '","url":"https://x.example/' || o_orderkey || '"}' AS value FROM orders""")
def snk_kafka(spark, d):
    """Messages published to where the configuration says, here a topic log."""
    path = _path(spark, "topics")
    messages.publish(_tasks(spark, d).select("task_id", "topic", messages.serialize("task_id", "url").alias("value")), {"log": path})
    return spark.read.format("topic_log").option("path", path).load().select("topic", "value")


@query("src_kafka", _TASKS)
def src_kafka(spark, d):
    """Messages of all topics of a log as one stream in micro-batches of bounded size, stopped and taken up again after more
    messages have come; broken ones are skipped."""
    base, t = new_folder(spark), _tasks(spark, d)
    wire = t.select("task_id", "topic", messages.serialize("task_id", "url").alias("value"))
    broken = wire.limit(5).select("task_id", "topic", F.lit("{broken").alias("value"))
    early = F.col("task_id").cast("long") % 2 == 0
    conf = {"log": f"{base}/log", "max_poll": str(t.count() // 3 + 1)}
    for part in (wire.where(early).unionByName(broken), wire.where(~early)):
        messages.publish(part, conf)
        out = run_available(messages.source(spark, conf), base=base, poll="0 seconds")
    return out.select("task_id", "url")


@query("src_s3_html", "SELECT page_id, html FROM pages")
def src_s3_html(spark, d):
    """Pages stored compressed and read back as text."""
    path = _path(spark, "html")
    T.table(spark, d, "pages").select("page_id", blobs.pack_zstd(F.col("html").cast("binary")).alias("content")).write.parquet(path)
    return spark.read.schema("page_id long, content binary").parquet(path).select("page_id", F.decode(blobs.unpack("content"), "UTF-8").alias("html"))


@query("src_s3_exists", "SELECT * FROM (VALUES (1, 'absent', false), (2, 'ensured', true), (3, 'written', true), (4, 'deleted', false), (5, 'deleted again', false)) t(step, what, present)")
def src_s3_exists(spark, d):
    """Whether a stored object is there before and after it is written and deleted."""
    path = _path(spark, "blob")
    rows = [(1, "absent", blobs.exists(spark, path)), (2, "ensured", blobs.ensure(spark, path))]
    T.table(spark, d, "nation").write.parquet(f"{path}/nation")
    rows.append((3, "written", blobs.exists(spark, f"{path}/nation")))
    blobs.delete(spark, path)
    rows += [(4, "deleted", blobs.exists(spark, path)), (5, "deleted again", blobs.delete(spark, path))]
    return spark.createDataFrame(rows, "step int, what string, present boolean")


@query("src_lambda")
def src_lambda(spark, d):
    """Pointer messages resolved to stored pages and extracted: one row for each pointer."""
    pages = T.product_pages(spark, d).withColumn("key", F.concat(F.lit("raw/"), F.col("page_id").cast("string")))
    pointers = pages.select(messages.payload(F.col("page_id").cast("string"), F.lit("b"), F.col("key")).alias("value"))
    asked = messages.good(pointers, messages.PAYLOAD).select("task_id", F.col("s3_raw_html_key").alias("key"))
    return extract(asked.join(pages.select("key", "url", "html"), "key"), "task_id").select("task_id", "n_fields", "success")


@query("ex_llm_heal", f"WITH pp AS ({T.PRODUCT_PAGES}) SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS brand, regexp_extract(url, '^https?://([^/]+)', 1) || ':h1' AS rule FROM pp")
def ex_llm_heal(spark, d):
    """Pages with missing fields, healed by rules that a model gives once for each kind of page; here one that takes the
    heading as brand. The rules go to the cache, with the domain they are for."""
    rule = F.struct(F.lit("brand").alias("field"), F.lit("css").alias("kind"), F.lit("h1").alias("selector"), F.lit(None).cast("string").alias("attribute"))
    model = lambda html: F.when(F.contains(html, F.lit("<h1>")), F.array(rule)).otherwise(F.array().cast(RULES))
    pages = T.product_pages(spark, d, rows=PARSED)
    cache = spark.createDataFrame([], f"domain string, path_pattern string, rules {RULES}, expires_at timestamp")
    found, added = extract_and_heal(pages, cache, F.lit("2024-01-01").cast("timestamp"), model, "page_id")
    rules = added.select("domain", F.concat_ws(":", "domain", F.col("rules")[0]["selector"]).alias("rule"))
    domains = pages.select("page_id", U.domain(F.col("url")).alias("domain")).join(rules, "domain")
    return found.join(domains, "page_id").select("page_id", F.col("fields")["brand"].alias("brand"), "rule")


@query("ex_multimodal", "SELECT page_id, 'n' || CAST(strlen(html) AS STRING) AS title FROM pages")
def ex_multimodal(spark, d):
    """Fields read from an image by a model; here its size."""
    shots = T.table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    read = read_screenshots(shots, lambda c: F.array(F.struct(F.lit("title").alias("name"), F.concat(F.lit("n"), F.octet_length(c).cast("string")).alias("value"))))
    return read.select("page_id", F.col("fields")[0]["value"].alias("title"))


@query("partition_pick", "SELECT o_orderkey, true AS even FROM orders")
def partition_pick(spark, d):
    """Rows dealt round robin; even tells whether a row's partition has at most 64 rows more than the smallest."""
    dealt = T.table(spark, d, "orders").select("o_orderkey").repartition(8).withColumn("p", F.spark_partition_id())
    sizes = dealt.groupBy("p").count()
    least = sizes.agg(F.min("count").alias("least"))
    return dealt.join(sizes.join(F.broadcast(least)), "p").select("o_orderkey", (F.col("count") - F.col("least") <= 64).alias("even"))


@query("st_pid_loop", LOOP)
def st_pid_loop(spark, d):
    """A rate after every fetch, controlled by the smoothed block indicator."""
    blocked = F.when(F.col("status_code").isin(403, 429), 1.0).otherwise(0.0)
    log = T.fetch_log(spark, d).select("domain", "ts", "event_id", blocked.alias("x"), F.lit(0.0).alias("ban"))
    rates = folds.ordered(log, "domain", ["ts", "event_id"], ["x", "ban"], folds.control(keep=0.9), "qps")
    return rates.select("domain", "event_id", F.round("qps", 6).alias("qps"))
