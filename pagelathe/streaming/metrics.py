"""Metrics of running streams: what a batch observes and how it went, as rows of a table."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: run is the stream's run id, name that of the metric: input_rows, batch_ms, or what observe() has been given.
SCHEMA = "run string, query string, batch long, ts string, name string, value double"


def observed(stream: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """stream with aggregates that each micro-batch reports as it runs, without a pass of their own."""
    return stream.observe(name, *(c.alias(k) for k, c in metrics.items()))


class ProgressTable(StreamingQueryListener):
    """Appends a row for each metric of each micro-batch to a table under path; null metrics leave none.

    Rows are held until a query ends or FLUSH of them have come, then written by one small job. Add it to spark.streams and
    take it off when done; table() waits for the ends of the queries given.
    """

    FLUSH = 10_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows: list[tuple] = []
        self.ended: set[str] = set()
        self.change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = {"input_rows": p.numInputRows, "batch_ms": p.batchDuration}
        for row in p.observedMetrics.values():
            found |= row.asDict()
        with self.change:
            self.rows += [(str(p.runId), p.name, p.batchId, p.timestamp, k, float(v)) for k, v in found.items() if v is not None]
            if len(self.rows) >= self.FLUSH:
                self._write()

    def onQueryTerminated(self, event) -> None:
        with self.change:
            self.ended.add(str(event.runId))
            self.change.notify_all()

    def _write(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def table(self, *runs: str, seconds: float = 60.0) -> DataFrame:
        """The table, once the queries of these run ids have ended."""
        with self.change:
            if not self.change.wait_for(lambda: set(runs) <= self.ended, seconds):
                raise TimeoutError("a query has not ended")
            self._write()
        return self.spark.read.schema(SCHEMA).parquet(self.path)
