"""Ordered windows over keys that may be hot: segmented prefix scans.

A key's rows are split into time buckets. Windows run inside a bucket, a bucket leaves one row of what it hands on, those rows
are scanned along a key, and a join brings each bucket what came before it. So a task holds a bucket of a key and never a
key; what is scanned is as many rows as a key has buckets.

A null key is a key of its own. Rows with a null time come first and share a bucket. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket.
BUCKET_SECONDS = 6 * 3600

_ALL = (Window.unboundedPreceding, -1)


def _bucketed(df: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """df with its segment: key and bucket in one column, which compares and joins null-safely."""
    return df.withColumn("__seg", F.struct(F.col(key).alias("k"), F.floor(F.unix_micros(ts) / F.lit(int(seconds * 1e6))).alias("b")))


def _along():
    """A key's segments before this one."""
    return Window.partitionBy(F.col("__seg.k")).orderBy(F.col("__seg.b")).rowsBetween(*_ALL)


def scan(df: DataFrame, key: str, ts: str, order: list[str], nth: str | None = None, seconds: float | None = None, **before: Column) -> DataFrame:
    """df with, for each name of before, the last value that is not null among a key's rows before a row by ts and order, null
    without one; and with nth a row's place among its key's rows, from 1."""
    rows = _bucketed(df, key, ts, seconds or BUCKET_SECONDS).withColumns({f"__v_{n}": c for n, c in before.items()})
    at = Window.partitionBy("__seg").orderBy(ts, *order)
    within = {f"__i_{n}": F.last(f"__v_{n}", ignorenulls=True).over(at.rowsBetween(*_ALL)) for n in before}
    if nth:
        within["__n"] = F.row_number().over(at)
    latest = [F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.struct(ts, *order))).alias(f"__h_{n}") for n in before]
    handed = rows.groupBy("__seg").agg(F.count("*").alias("__c"), *latest)
    come = handed.select("__seg", F.coalesce(F.sum("__c").over(_along()), F.lit(0)).alias("__base"), *(F.last(f"__h_{n}", ignorenulls=True).over(_along()).alias(f"__h_{n}") for n in before))
    both = rows.withColumns(within).join(come, "__seg", "left")  # rows stay where they are
    found = [F.coalesce(f"__i_{n}", f"__h_{n}").alias(n) for n in before]
    return both.select(*df.columns, *found, *([(F.col("__n") + F.col("__base")).alias(nth)] if nth else []))


def streak(df: DataFrame, key: str, ts: str, order: list[str], ok: Column, name: str = "streak", seconds: float | None = None) -> DataFrame:
    """df with how many of a key's rows up to a row have failed in a row, 0 for one that is ok. A null ok is a failure."""
    rows = _bucketed(df, key, ts, seconds or BUCKET_SECONDS).withColumn("__ok", F.coalesce(ok, F.lit(False)))
    at = Window.partitionBy("__seg").orderBy(ts, *order)
    placed = rows.withColumn("__n", F.row_number().over(at))
    placed = placed.withColumn("__p", F.max(F.when(F.col("__ok"), F.col("__n"))).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    handed = placed.groupBy("__seg").agg(F.count("*").alias("__c"), F.max("__p").alias("__last"))
    based = handed.withColumn("__base", F.coalesce(F.sum("__c").over(_along()), F.lit(0)))
    # a key's failures at a segment's begin: its rows so far less the place of the last that was ok
    come = based.select("__seg", (F.col("__base") - F.coalesce(F.last(F.col("__base") + F.col("__last"), ignorenulls=True).over(_along()), F.lit(0))).alias("__come"))
    return placed.join(come, "__seg", "left").select(*df.columns, F.when(F.col("__p").isNull(), F.col("__n") + F.col("__come")).otherwise(F.col("__n") - F.col("__p")).cast("long").alias(name))


def arrivals(df: DataFrame, key: str, ts: str, seconds: float, name: str = "n") -> DataFrame:
    """df with the number of a key's rows in the seconds before a row, those of its own time left out; null for a null time.

    Buckets are as wide as that span, and a row also stands in the next one, so a row's span lies in its bucket.
    """
    us = int(seconds * 1e6)
    t = F.unix_micros(ts)
    bucket = F.floor(t / F.lit(us))
    copies = F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))
    rows = df.withColumns({"__t": t, "__copy": F.explode(copies)}).withColumn("__seg", F.struct(F.col(key).alias("k"), F.col("__copy.b").alias("b")))
    span = Window.partitionBy("__seg").orderBy("__t").rangeBetween(-us, -1)
    counted = rows.withColumn("__c", F.count("*").over(span)).where("__copy.own")
    return counted.select(*df.columns, F.when(F.col("__t").isNotNull(), F.col("__c")).alias(name))
