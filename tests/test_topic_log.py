"""The topic log as a data source: batches, streams, restarts, aborts, and what is pending."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelathe.sources import messages, topic_log
from pagelathe.streaming.sources import run_available

KIND = "topic string, key string, value string"


@pytest.fixture()
def log(spark, tmp_path):
    topic_log.register(spark)
    return str(tmp_path / "log")


def put(spark, path, rows, **options):
    df = spark.createDataFrame(rows, KIND)
    df.write.format("topic_log").option("path", path).options(**options).mode("append").save()


def read(spark, path, **options):
    return spark.read.format("topic_log").option("path", path).options(**options).load()


def rows_of(n, first=0):
    return [(["high", "low"][i % 2], None if i % 3 else f"k{i % 7}", f"v{i}\né") for i in range(first, first + n)]


def test_offsets_run_on(spark, log, monkeypatch):
    """Every message once, offsets of a partition from 0 without gaps over several writes, a key always in one partition."""
    monkeypatch.setattr(topic_log, "SEGMENT_ROWS", 10)
    for first in (0, 100, 300):
        put(spark, log, rows_of(100 if first < 300 else 1, first), partitions="3")
    got = read(spark, log).collect()
    want = rows_of(200) + rows_of(1, 300)
    assert sorted((r.topic, r.key or "", r.value) for r in got) == sorted((t, k or "", v) for t, k, v in want)
    at = {}
    for r in got:
        at.setdefault((r.topic, r.partition), []).append(r.offset)
    assert all(sorted(v) == list(range(len(v))) for v in at.values()) and len(at) == 6
    keys = {(r.topic, r.key): r.partition for r in got if r.key}
    assert all(keys[r.topic, r.key] == r.partition for r in got if r.key)
    assert {r.topic for r in read(spark, log, topics="low").collect()} == {"low"}
    assert read(spark, log, topics="none").collect() == [] and read(spark, log + "x").collect() == []


def test_a_failed_write_leaves_nothing(spark, log):
    put(spark, log, rows_of(10))
    bad = spark.createDataFrame(rows_of(400), KIND).repartition(4).withColumn("value", F.when(F.col("value").startswith("v399"), F.raise_error(F.lit("stop"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("topic_log").option("path", log).mode("append").save()
    folder = topic_log.Folder(log)
    assert read(spark, log).count() == 10 and folder._list(f"{folder.root}/staging") == []
    put(spark, log, rows_of(5))
    assert read(spark, log).count() == 15
    with pytest.raises(Exception, match="only appended"):
        spark.createDataFrame(rows_of(1), KIND).write.format("topic_log").option("path", log).mode("overwrite").save()


def test_stream_restarts_where_it_was(spark, log, tmp_path):
    """Micro-batches of at most max_poll messages; after a restart only what has come since; the group's commits follow."""
    base = str(tmp_path / "run")
    source = lambda: spark.readStream.format("topic_log").option("path", log).option("group", "g").option("max_poll", "40").load()
    put(spark, log, rows_of(150))
    assert topic_log.queue_depth(log, "high", "g") == -1
    first = run_available(source(), base=base, poll="0 seconds", number="batch")
    sizes = [r["count"] for r in first.groupBy("batch").count().collect()]
    assert sum(sizes) == 150 and max(sizes) <= 40 and len(sizes) >= 4
    put(spark, log, rows_of(60, 150))
    pending = topic_log.queue_depth(log, "high", "g")
    assert pending >= 30 and topic_log.queue_depth(log, "nothing", "g") == 0
    both = run_available(source(), base=base, poll="0 seconds")
    assert sorted(r.value for r in both.collect()) == sorted(v for _, _, v in rows_of(210))
    assert both.select("topic", "partition", "offset").distinct().count() == 210
    third = run_available(source(), base=base, poll="0 seconds")
    assert third.count() == 210


def test_stream_writes_a_batch_once(spark, log, tmp_path):
    """A stream from one log to another, run again from the start under the same name: committed batches add nothing."""
    put(spark, log, rows_of(90))
    to = str(tmp_path / "to")
    for checkpoint in ("a", "b"):
        source = spark.readStream.format("topic_log").option("path", log).load().select("topic", "key", "value")
        run = source.writeStream.format("topic_log").option("path", to).option("name", "copy").option("checkpointLocation", str(tmp_path / checkpoint)).start()
        run.processAllAvailable()
        run.stop()
        assert sorted(r.value for r in read(spark, to).collect()) == sorted(v for _, _, v in rows_of(90))


def test_a_half_moved_commit_is_finished(log):
    """Moves that were done before a crash are not done again."""
    import pyarrow as pa

    folder = topic_log.Folder(log)
    batch = pa.RecordBatch.from_pydict({"topic": ["t"] * 6, "key": list("abcdef"), "value": list("uvwxyz")})
    staged = topic_log._stage(folder, "run1", 3, iter([batch]))
    one = topic_log.Staged(sorted(staged.found)[:1])
    topic_log._publish(folder, "none", "s_0", [one])
    again = topic_log._stage(folder, "run2", 3, iter([batch]))
    topic_log._publish(folder, "run2", "s_0", [again])
    assert sum(s.count for s in folder.segments("t")) == 6


def test_messages_through_the_log(spark, log):
    df = spark.createDataFrame([("1", "high", '{"task_id":"1","url":"u"}'), ("2", "other", '{"task_id":"2"}'), ("3", "low", "{broken")], "task_id string, topic string, value string")
    messages.publish(df, {"log": log})
    assert [r.task_id for r in run_available(messages.source(spark, {"log": log}), poll="0 seconds").collect()] == ["1"]
