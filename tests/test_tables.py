from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagelathe import api
from pagelathe.operators import aggregates as A
from pagelathe.operators import tables as O
from pagelathe.operators.alerts import threshold_alerts
from pagelathe.operators.quality import check_rules, fix_rules
from pagelathe.sources import blobs, messages


def test_upsert_merges_given_columns(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    new = spark.createDataFrame([(2, "n", 1), (2, "newer", 2), (3, None, 1)], "k long, v string, at long")
    assert sorted(map(tuple, O.upsert(old, new, "k", "at").collect())) == [(1, "a", "x"), (2, "newer", "y"), (3, None, None)]


def test_cache(spark):
    cache = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1)), ("b", 2, dt.datetime(2024, 1, 3))], "k string, v long, expires_at timestamp")
    assert [r.k for r in O.valid_at(cache, F.lit("2024-01-01").cast("timestamp")).collect()] == ["b"]
    put = O.put(cache, cache.limit(1).withColumn("v", F.lit(9).cast("long")), "k")
    assert sorted((r.k, r.v) for r in put.collect()) == [("a", 9), ("b", 2)]


def test_paging_and_updates(spark):
    df = spark.range(100).withColumn("s", F.col("id") % 3)
    assert [r.id for r in O.page(df, [F.desc("id")], 2, 1, s=0).collect()] == [96, 93]
    assert O.update_where(df, F.col("s") == 1, {"s": F.lit(7).cast("long")}).where("s = 7").count() == 33
    assert O.get(df, id=5).count() == 1 and O.matching(df, s=None).count() == 100


def test_messages(spark):
    wire = spark.createDataFrame([('{"task_id":"1","url":"u","priority":5}',), ("{broken",), (None,)], "value string")
    assert [(r.task_id, r.priority) for r in messages.good(wire, messages.TASK).collect()] == [("1", 5)]
    assert messages.broken(wire, messages.TASK).where("value IS NOT NULL").count() == 1
    p = spark.range(1).select(messages.payload(F.lit("t"), F.lit("b"), F.lit("k")).alias("p")).first().p
    assert len(p) < 300 and "screenshot" not in p and "<html" not in p


def test_topics(spark, tmp_path):
    path = str(tmp_path / "topics")
    df = spark.createDataFrame([("high", '{"task_id":"1"}'), ("low", '{"task_id":"2"}')], "topic string, value string")
    messages.write_topics(df, path)
    assert sorted((r.topic, r.value) for r in spark.read.json(path).collect()) == [("high", '{"task_id":"1"}'), ("low", '{"task_id":"2"}')]


def test_blobs(spark):
    raw = [b"A" * 400, b"", "é".encode() * 50, None]
    df = spark.createDataFrame([(b,) for b in raw], "raw binary")
    got = df.select("raw", blobs.unpack(blobs.pack_gzip("raw")).alias("g"), blobs.unpack(blobs.pack_zstd("raw")).alias("z"), F.octet_length(blobs.pack_gzip("raw")).alias("n")).collect()
    assert all(r.g == r.raw and r.z == r.raw for r in got) and got[0].n < 60
    assert spark.range(1).select(blobs.compression_ratio(F.lit(0), F.lit(0)).alias("r")).first().r == 0


def test_stored_pages(spark, tmp_path):
    import gzip

    (tmp_path / "a.gz").write_bytes(gzip.compress("<p>é</p>".encode()))
    (tmp_path / "b.html").write_bytes(b"plain")
    assert sorted(r.html for r in blobs.read_html(spark, str(tmp_path)).collect()) == ["<p>é</p>", "plain"]
    assert blobs.exists(spark, str(tmp_path / "a.gz")) and not blobs.exists(spark, str(tmp_path / "none"))


def test_nearest_rank(spark):
    for n, p, expected in [(4, 0.5, 3), (1, 0.99, 1), (100, 0.99, 100), (0, 0.5, 0.0), (3, 0.0, 1)]:
        values = F.array(*map(F.lit, [float(i) for i in range(1, n + 1)])) if n else F.array().cast("array<double>")
        assert spark.range(1).select(A.nearest_rank(values, p).alias("x")).first().x == expected


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, 999), (2, 8), (3, None)], "id long, cores int")
    got = {r.id: (list(r.errors), list(r.warnings), r.valid) for r in check_rules(df, {"cores": F.col("cores") > 128}, {"odd": F.col("cores") % 2 == 1}).collect()}
    assert got == {1: (["cores"], ["odd"], False), 2: ([], [], True), 3: ([], [], True)}
    assert {r.id: (r.cores, r.n_fixed) for r in fix_rules(df, {"cores": (F.col("cores") > 128, F.lit(8))}).collect()} == {1: (8, 1), 2: (8, 0), 3: (None, 0)}


def test_alerts_must_hold(spark):
    series = spark.createDataFrame([("a", i, 0.6) for i in (1, 2, 3, 7, 9)] + [("b", 1, 0.2)], "domain string, bucket long, value double")
    assert [(r.domain, r.start, r.length) for r in threshold_alerts(series, "HighBanScore").collect()] == [("a", 1, 3)]


def test_service_functions(spark):
    t = spark.createDataFrame([("1", "pending", "a", 1), ("2", "success", "a", 2), ("3", "success", "b", 3)], "task_id string, status string, domain string, created_at long")
    assert [r.task_id for r in api.tasks(t).collect()] == ["3", "2", "1"] and [r.task_id for r in api.tasks(t, "success", "a").collect()] == ["2"]
    assert [r.task_id for r in api.results(t, 1).collect()] == ["3"] and api.task(t, "9").count() == 0 and api.result(t, "1").count() == 1
    assert [r.task_id for r in api.pending_batch(t, t.where("status = 'success'")).collect()] == ["1"]
    log = spark.createDataFrame([("a", "http", 200, "", 10.0, dt.datetime(2024, 1, 1), 1)], "domain string, engine string, status_code int, challenge_type string, latency_ms double, ts timestamp, event_id long")
    assert api.domain_stats(log).first().p50 == 10.0 and api.metrics(log).first().value == 1.0


def test_topics_by_configuration(spark, tmp_path):
    """Folders by default; with servers the Kafka format is asked for, with its options and columns."""
    rows = spark.createDataFrame([("1", "high", '{"task_id":"1"}'), ("2", "low", "{broken")], "task_id string, topic string, value string")
    conf = {"path": str(tmp_path / "topics")}
    messages.publish(rows, conf)
    from pagelathe.streaming.sources import run_available

    assert [r.task_id for r in run_available(messages.source(spark, conf)).collect()] == ["1"]
    assert messages.kafka_rows(rows).columns == ["key", "value", "topic"]
    for call in (lambda: messages.source(spark, {"servers": "h:9092"}), lambda: messages.publish(rows, {"servers": "h:9092"})):
        with pytest.raises(Exception, match="(?i)kafka"):
            call()


def test_blobs_come_and_go(spark, tmp_path):
    where = str(tmp_path / "a" / "b")
    assert not blobs.exists(spark, where) and blobs.ensure(spark, where) and blobs.exists(spark, where)
    assert blobs.delete(spark, where) and not blobs.delete(spark, where)
    if not blobs.BROTLI:
        with pytest.raises(Exception, match="brotli"):
            spark.range(1).select(blobs.pack_brotli(F.lit(b"x").cast("binary"))).collect()
