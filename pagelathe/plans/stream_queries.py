"""Streams over events, run to the end of what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelathe.functions import responses as R
from pagelathe.functions import urls as U
from pagelathe.operators import folds
from pagelathe.plans.fold_queries import _SPACED, LOOP, _L
from pagelathe.plans.registry import ORACLES, query
from pagelathe.sources import messages
from pagelathe.sources import tables as T
from pagelathe.streaming import windows as W
from pagelathe.streaming.sources import new_folder, run_available, stream_table
from pagelathe.streaming.stateful import fold_stream


def _log(spark, d, events=None):
    """The fetch log as a stream."""
    return spark.sql(T.FETCH_LOG.replace("FROM events", "FROM {events}"), events=stream_table(spark, d, "events") if events is None else events)


#: The watermark after the last row: a window is given out once its end is no later than that.
_CLOSED = "SELECT max(ts) - INTERVAL 1 HOUR FROM events"


@query("ss_tumbling", f"SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING start + INTERVAL 1 DAY <= ({_CLOSED})")
def ss_tumbling(spark, d):
    """Closed days; the state of a day goes once it has been given out."""
    return run_available(W.windowed(stream_table(spark, d, "events"), ["event_type"], "1 day"))


@query("ss_sliding", f"SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2 HAVING start + INTERVAL 2 HOUR <= ({_CLOSED})")
def ss_sliding(spark, d):
    return run_available(W.windowed(stream_table(spark, d, "events"), ["event_type"], "2 hours", "1 hour"))


@query("ss_session", f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= ({_CLOSED})")
def ss_session(spark, d):
    """Closed sessions."""
    return run_available(W.sessions(stream_table(spark, d, "events"), ["user_id"], "6 hours"))


def _in_parts(spark, frames):
    """Frames written one after the other as a stream that takes one file at a time."""
    path = f"{new_folder(spark)}/in"
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("ss_watermark", f"SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING start + INTERVAL 1 DAY <= ({_CLOSED})")
def ss_watermark(spark, d):
    """Days from a stream in six batches, the last of which repeats rows of long closed days: the watermark drops them."""
    e = T.table(spark, d, "events").select("ts", "event_type")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    cuts = [lo + (hi - lo) * k / 5 for k in range(5)]
    parts = [e.where(F.col("ts") >= a) if b is None else e.where((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
    return run_available(W.windowed(_in_parts(spark, [*parts, parts[0]]), ["event_type"], "1 day"))


_DAY = 86400 * 10**6
_KEYED = f"{_L}, g AS (SELECT *, left(sha256('https://x.example/' || CAST(user_id AS STRING)), 16) AS key FROM f)"


def _keyed(log):
    return log.select(U.dedup_key(F.concat(F.lit("https://x.example/"), F.col("user_id").cast("string"))).alias("key"), "ts", "event_id")


@query("ss_dedup", _SPACED.format(with_=_KEYED, key="key", rows="g", us=_DAY))
def ss_dedup(spark, d):
    """Exact time-to-live deduplication; a key's state goes when its time is over."""
    return run_available(fold_stream(_keyed(_log(spark, d)), "key", "ts", "event_id", [], folds.spacing(_DAY), "ok"))


@query("ss_commit", _SPACED.format(with_=_KEYED, key="key", rows="g", us=_DAY))
def ss_commit(spark, d):
    """The same, stopped half way and taken up again from the checkpoint: every row once, and the state is as it was."""
    e = T.table(spark, d, "events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    early = F.col("ts") < lo + (hi - lo) / 2
    base = new_folder(spark)
    for part in (e.where(early), e.where(~early)):
        part.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(e.schema).parquet(f"{base}/in")
        out = run_available(fold_stream(_keyed(_log(spark, d, source)), "key", "ts", "event_id", [], folds.spacing(_DAY), "ok"), base=base)
    return out


@query("ss_dedup_approx")
def ss_dedup_approx(spark, d):
    """Deduplication by the watermark."""
    return run_available(W.dedup_approximate(stream_table(spark, d, "events").select("ts", "user_id", "event_id"), "user_id")).select("user_id", "event_id")


@query("ss_rate")
def ss_rate(spark, d):
    """Greedy admission; equals the batch query st_token."""
    return run_available(fold_stream(_log(spark, d), "domain", "ts", "event_id", [], folds.admission(36000 * 10**6, 2), "ok"))


@query("ss_ema", f"WITH {_L}, l AS (SELECT domain, list(CASE WHEN status_code IN (403, 429) THEN 1.0::DOUBLE ELSE 0.0 END ORDER BY ts, event_id) AS r FROM f GROUP BY domain) SELECT domain, round(list_reduce(r, lambda a, x: a * 0.7::DOUBLE + x * 0.3::DOUBLE, 0.0::DOUBLE), 6) AS score FROM l")
def ss_ema(spark, d):
    """Smoothed block indicator of domains, the last value of each."""
    log = _log(spark, d).withColumn("x", F.when(F.col("status_code").isin(403, 429), 1.0).otherwise(0.0))
    scores = run_available(fold_stream(log, "domain", "ts", "event_id", ["x"], folds.smoothing(0.7), "score"))
    return scores.groupBy("domain").agg(F.round(F.max_by("score", "event_id"), 6).alias("score"))


@query("ss_pid", LOOP)
def ss_pid(spark, d):
    """A rate after every fetch, controlled by the smoothed block indicator; equals st_pid_loop."""
    log = _log(spark, d).withColumns({"x": F.when(F.col("status_code").isin(403, 429), 1.0).otherwise(0.0), "ban": F.lit(0.0)})
    rates = run_available(fold_stream(log, "domain", "ts", "event_id", ["x", "ban"], folds.control(keep=0.9), "qps"))
    return rates.select("domain", "event_id", F.round("qps", 6).alias("qps"))


def _judged(spark, d):
    return _log(spark, d).withColumn("ok", R.is_success(F.col("status_code")))


@query("ss_breaker")
def ss_breaker(spark, d):
    """A breaker's state after every fetch; equals the batch query st_breaker."""
    fold = folds.domain_breaker(4, 7200.0 * 10**6, 3, 86400.0 * 10**6)
    return run_available(fold_stream(_judged(spark, d), "domain", "ts", "event_id", ["ok"], fold, "state"))


@query(
    "ss_backpressure",
    f"""WITH {_L}, l AS (SELECT domain, list({{'o': event_id, 'ok': status_code BETWEEN 200 AND 299, 'n': 5.0::DOUBLE, 'g': 0, 'b': 0, 'v': []::DOUBLE[]}} ORDER BY ts, event_id) AS e FROM f GROUP BY domain),
r AS (SELECT domain, list_transform(e, lambda y: y.o) AS o, list_reduce(e, lambda a, x: {{'o': x.o, 'ok': x.ok,
  'n': CASE WHEN x.ok AND a.g = 7 THEN least(5.0::DOUBLE, a.n + 0.5) WHEN NOT x.ok AND a.b = 1 THEN greatest(1.0::DOUBLE, a.n / 2) ELSE a.n END,
  'g': CASE WHEN x.ok AND a.g < 7 THEN a.g + 1 ELSE 0 END, 'b': CASE WHEN NOT x.ok AND a.b < 1 THEN a.b + 1 ELSE 0 END,
  'v': list_append(a.v, CASE WHEN x.ok AND a.g = 7 THEN least(5.0::DOUBLE, a.n + 0.5) WHEN NOT x.ok AND a.b = 1 THEN greatest(1.0::DOUBLE, a.n / 2) ELSE a.n END)}},
  {{'o': 0::BIGINT, 'ok': true, 'n': 5.0::DOUBLE, 'g': 0, 'b': 0, 'v': []::DOUBLE[]}}).v AS v FROM l),
s AS (SELECT domain, unnest(o) AS event_id, unnest(v) AS slots FROM r) SELECT domain, event_id, slots, CASE WHEN event_id % 2000 >= 1000 THEN least(CAST(floor(50 - 10 * slots) AS BIGINT), event_id % 2000 - 1000, 40) ELSE 0 END AS offload FROM s""",
)
def ss_backpressure(spark, d):
    """A domain's concurrency after every fetch, and how many tasks of the queue behind it go to overflow workers: with
    1,000 or more waiting as many as there are slots left, excess tasks, and workers, whichever is least."""
    slots = run_available(fold_stream(_judged(spark, d), "domain", "ts", "event_id", ["ok"], folds.aimd(), "slots"))
    depth = F.col("event_id") % 2000
    n = F.when(depth >= 1000, F.least(F.floor(50 - 10 * F.col("slots")), depth - 1000, F.lit(40))).otherwise(0)
    return slots.withColumn("offload", n.cast("long"))


@query("ss_poll", "SELECT s_suppkey, 'https://x.example/' || CAST(s_suppkey AS STRING) AS url, true AS fits FROM supplier")
def ss_poll(spark, d):
    """A scheduler that polls for at most 200 tasks every 500 ms until none is left; fits tells whether its poll kept that."""
    tasks = T.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("https://x.example/"), F.col("s_suppkey").cast("string")).alias("url"))
    path = f"{new_folder(spark)}/in"
    tasks.write.option("maxRecordsPerFile", 200).parquet(path)
    source = spark.readStream.schema(tasks.schema).option("maxFilesPerTrigger", 1).parquet(path)
    polled = run_available(source, poll="500 milliseconds", number="poll")
    sizes = polled.groupBy("poll").agg((F.count("*") <= 200).alias("fits"))
    return polled.join(sizes, "poll").select("s_suppkey", "url", "fits")


@query("ss_ingest", "SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'high' WHEN event_id % 3 = 1 THEN 'normal' ELSE 'low' END AS topic, count(*) AS n FROM events WHERE event_id % 50 <> 0 GROUP BY 1, 2")
def ss_ingest(spark, d):
    """Messages of three topics parsed from a stream; broken ones are skipped."""
    e = stream_table(spark, d, "events")
    topic = F.when(F.col("event_id") % 3 == 0, "high").when(F.col("event_id") % 3 == 1, "normal").otherwise("low")
    wire = e.select(F.when(F.col("event_id") % 50 == 0, F.lit("{broken")).otherwise(messages.serialize(F.col("user_id").cast("string").alias("task_id"), topic.alias("domain"))).alias("value"))
    rows = run_available(messages.good(wire, messages.TASK).select(F.col("task_id").cast("long").alias("user_id"), F.col("domain").alias("topic")))
    return rows.groupBy("user_id", "topic").agg(F.count("*").alias("n"))


@query("ss_dlq", """SELECT 'tasks' AS route, '{"task_id":"' || event_id || '"}' AS value FROM events WHERE event_id % 50 <> 0 UNION ALL SELECT 'dead_letter', '{"task_id":"' || event_id FROM events WHERE event_id % 50 = 0""")
def ss_dlq(spark, d):
    """Messages of a stream, the broken ones written to a dead-letter folder as they are."""
    e = stream_table(spark, d, "events")
    whole = F.concat(F.lit('{"task_id":"'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 50 != 0, '"}').otherwise(""))
    wire, base = e.select(whole.alias("value")), new_folder(spark)

    def bury(batch, nth: int) -> None:
        messages.broken(batch, messages.TASK).write.mode("overwrite").parquet(f"{base}/dead/batch={nth}")

    taken = run_available(wire, each=bury, base=base)
    tasks = messages.good(taken, messages.TASK).select(F.lit("tasks").alias("route"), messages.serialize("task_id").alias("value"))
    return tasks.unionByName(spark.read.schema("value string").parquet(f"{base}/dead").select(F.lit("dead_letter").alias("route"), "value"))


for _stream, _batch in (("ss_rate", "st_token"), ("ss_breaker", "st_breaker")):
    ORACLES[_stream] = ORACLES[_batch]


@query("ss_metrics", f"WITH {_L} SELECT unnest(['input_rows', 'rows', 'failed', 'blocked']) AS name, unnest([count(*), count(*), count(*) FILTER (status_code >= 400), count(*) FILTER (status_code IN (403, 429))])::DOUBLE AS value FROM f")
def ss_metrics(spark, d):
    """Totals of what the micro-batches of a running stream have observed and reported, read from the table of their progress."""
    from pagelathe.streaming.metrics import ProgressTable, observed

    base = new_folder(spark)
    progress = ProgressTable(spark, f"{base}/progress")
    spark.streams.addListener(progress)
    try:
        status = F.col("status_code")
        seen = observed(_log(spark, d), "fetches", rows=F.count("*"), failed=F.count_if(status >= 400), blocked=F.count_if(status.isin(403, 429)))
        run = seen.writeStream.format("noop").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        table = progress.table(str(run.runId))
    finally:
        spark.streams.removeListener(progress)
    return table.where("name <> 'batch_ms'").groupBy("name").agg(F.sum("value").alias("value"))
