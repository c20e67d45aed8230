"""Task and result functions over tables: what a service in front of the engine would call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions import urls as U
from pagelathe.operators import aggregates as A
from pagelathe.operators import tables as O

MAX_PAGE = 500


def submit(urls: DataFrame, url: str = "url", priority: Column | int = 0) -> DataFrame:
    """New tasks of URLs: a stable id from the URL, domain, priority (scored where 0), topic and status."""
    u = F.col(url)
    given = priority if isinstance(priority, Column) else F.lit(priority)
    p = F.when(given == 0, U.url_score(u)).otherwise(given)
    valid = p.between(0, 100)
    return urls.select(F.sha2(u, 256).alias("task_id"), u.alias("url"), U.domain(u).alias("domain"), p.alias("priority"), F.when(valid, U.url_topic(p)).alias("topic"), F.when(valid, "pending").otherwise("invalid").alias("status"))


def task(tasks: DataFrame, task_id: str) -> DataFrame:
    return O.get(tasks, task_id=task_id)


def tasks(all_tasks: DataFrame, status: str | None = None, domain: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of tasks, newest first."""
    return O.page(all_tasks, [F.desc("created_at"), F.col("task_id")], min(max(limit, 1), MAX_PAGE), offset, status=status, domain=domain)


def result(results: DataFrame, task_id: str) -> DataFrame:
    return O.get(results, task_id=task_id)


def results(all_results: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of successful results, newest first."""
    return O.page(all_results, [F.desc("created_at"), F.col("task_id")], min(max(limit, 1), MAX_PAGE), offset, status="success")


def domain_stats(log: DataFrame) -> DataFrame:
    return A.health(log, "domain").join(A.latency(log), "domain", "left")


def metrics(log: DataFrame) -> DataFrame:
    """name, labels, value of the counters of a fetch log."""
    n = log.groupBy("domain", "engine", "status_code").count()
    labels = F.create_map(F.lit("domain"), "domain", F.lit("engine"), "engine", F.lit("status_code"), F.col("status_code").cast("string"))
    return n.select(F.lit("http_requests_total").alias("name"), labels.alias("labels"), F.col("count").cast("double").alias("value"))


def pending_batch(queued: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    return O.delete(queued, done.select(key), key)
