"""Sessions with the settings that the library's queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "pagelathe", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, last-wins map merging, Arrow batches small enough for HTML rows."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        # the call site of every column costs more than building the column
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
