"""Table operations: lookups by equality, paging, updates, deletes, upserts, caches with expiry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; values that are None do not filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in equal.items() if v is not None), df)


def get(df: DataFrame, **equal) -> DataFrame:
    return matching(df, **equal).limit(1)


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0, **equal) -> DataFrame:
    """A page of the matching rows. The order should end in a unique column; a small page is a top-k, not a sort."""
    return matching(df, **equal).orderBy(*order).offset(offset).limit(limit)


def update_where(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """df with columns set where a condition holds; null conditions change nothing."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """old with the rows of new merged by key: columns that new supplies (not null) replace, the rest stays.

    Of several new rows of a key the one with the largest value of at counts.
    """
    if at:
        new = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), at).alias("n")).select("n.*").drop(at)
    a, b = old.alias("a"), new.alias("b")
    columns = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in new.columns else F.col(f"a.{c}") for c in old.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*columns)


def valid_at(cache: DataFrame, ts: Column) -> DataFrame:
    """Entries that have not expired; expires_at itself is already too late."""
    return cache.where(F.col("expires_at") > ts)


def put(cache: DataFrame, entries: DataFrame, key: str | list[str]) -> DataFrame:
    """The cache with entries added, replacing those of the same key."""
    return delete(cache, entries, key).unionByName(entries)


def batch_numbers(df: DataFrame, key: str, size: int = 20) -> DataFrame:
    """df with a batch number inside each of its key's hash buckets; the writer inserts a batch at a time."""
    from pyspark.sql import Window

    bucket = F.pmod(F.xxhash64(key), F.lit(64)).cast("int")
    w = Window.partitionBy("bucket").orderBy(key)
    return df.withColumn("bucket", bucket).withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
