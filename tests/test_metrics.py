"""Sketches beside exact counts, global aggregations of empty tables, and metrics of running streams."""

from __future__ import annotations

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from pagelathe.operators import aggregates as A
from pagelathe.plans import catalog
from pagelathe.streaming.metrics import ProgressTable, observed

SF = "/root/testdata/sf0.001"


def test_sketches_of_days(spark):
    """Exact counts, and estimates of days and spans of days within 2 %."""
    df = spark.range(400_000).select((F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 10 * 86400)).alias("ts"), F.concat(F.lit("u"), (F.col("id") * 7919 % 60_013).cast("string")).alias("url"))
    df = df.unionByName(spark.createDataFrame([(None, "x"), (dt.datetime(2024, 1, 1), None)], "ts timestamp, url string"))
    days = A.seen_by_day(df, "ts", "url").cache()
    want = {r.day: r.n for r in df.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("url").alias("n")).collect()}
    got = days.select("day", "exact", F.hll_sketch_estimate("sketch").alias("e")).collect()
    assert {r.day: r.exact for r in got} == want and len(got) == 11
    assert all(abs(r.e - r.exact) <= max(1, 0.02 * r.exact) for r in got)
    for since, until in (("2024-01-01", "2024-01-03"), ("2024-01-02", "2024-01-10")):
        exact = df.where(F.to_date("ts").between(since, until)).agg(F.count_distinct("url")).first()[0]
        assert abs(A.seen_in(days, since, until).first().estimate - exact) < 0.02 * exact
    assert A.seen_in(days, "2030-01-01", "2030-01-02").first().estimate == 0
    days.unpersist()


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    """The tables without rows."""
    folder = tmp_path_factory.mktemp("empty")
    for t in ("orders", "events", "customer", "supplier", "part", "nation", "pages", "lineitem"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    yield str(folder)
    shutil.rmtree(folder, ignore_errors=True)


@pytest.mark.parametrize("name", ["agg_dash", "agg_bandit", "argmax_arm", "agg_dedup_count", "agg_dedup_days", "alert_rules", "win_rate", "win_streak", "win_rr", "st_token", "st_breaker", "st_pid_loop", "st_dns", "st_cookie", "jn_cache", "jn_engine", "sm_ucb", "sm_exp3", "snk_upsert", "snk_delete"])
def test_empty_tables(spark, empty, name):
    rows = catalog.queries()[name](spark, empty).collect()
    if name in ("agg_dash", "agg_bandit", "agg_dedup_count", "argmax_arm"):
        assert len(rows) == 1 and all(v in (None, 0) for v in rows[0])
    else:
        assert rows == []


def test_progress_of_a_stream(spark, tmp_path):
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    progress = ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(progress)
    try:
        source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = observed(source, "ids", n=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1), most=F.max("id")).writeStream.format("noop").queryName("ids").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
        rows = progress.table(str(run.runId)).collect()
    finally:
        spark.streams.removeListener(progress)
    by = {}
    for r in rows:
        by.setdefault(r.name, {})[r.batch] = r.value
    assert sum(by["n"].values()) == 30 and sum(by["odd"].values()) == 15 and max(by["most"].values()) == 29 and len(by["n"]) >= 3
    assert set(by) == {"input_rows", "batch_ms", "n", "odd", "most"} and {r.query for r in rows} == {"ids"}
    with pytest.raises(TimeoutError):
        progress.table("another", seconds=0.1)
