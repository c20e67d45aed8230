"""Tables that are changed in place: Parquet laid out by buckets of a key, of which a change rewrites those that it touches.

A bucket is a folder. A change reads the buckets that its keys fall into, and writes them again by Spark's dynamic partition
overwrite, which puts all files aside first and moves them at the end; other buckets' files stay as they are. Every bucket holds
a row that marks it, so one whose last row goes is rewritten, too. A change that is stopped while files are moved may have
reached some buckets only; upserts, deletes and settings of values can be done again, to the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelathe.operators import tables as O

BUCKET, LIVE = "__bucket", "__live"


class KeyedTable:
    """A table under path with the columns of schema, in buckets of its key column (which need not be unique, and may be null).

    The bucket count is fixed when the table is made; a bucket should hold what one task writes in some seconds.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = 16) -> KeyedTable:
        """A new table of the rows of df. Fails if path exists."""
        table = cls(df.sparkSession, path, df.schema, key, buckets)
        table._write(df, df.sparkSession.range(buckets).select(F.col("id").cast("int").alias(BUCKET)), "errorifexists")
        return table

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, touched: DataFrame, mode: str = "overwrite") -> None:
        own = rows.select(*self.schema.names).withColumns({LIVE: F.lit(True), BUCKET: self._bucket(F.col(self.key))})
        marks = touched.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields), F.lit(False).alias(LIVE), BUCKET)
        # a bucket is written by one task, as one file
        both = own.unionByName(marks).repartition(self.buckets, BUCKET)
        both.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _stored(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(LIVE, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path).where(LIVE)

    def read(self) -> DataFrame:
        return self._stored().drop(LIVE, BUCKET)

    def get(self, key) -> DataFrame:
        """The rows of a key, from its bucket alone."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(key).cast(self.schema[self.key].dataType))).first()[0]
        return self._stored().where((F.col(BUCKET) == bucket) & (F.col(self.key) == F.lit(key))).drop(LIVE, BUCKET)

    def _rows(self, touched: list[int]) -> DataFrame:
        """The stored rows of some buckets, read from their folders only."""
        return self._stored().where(F.col(BUCKET).isin(touched)).drop(LIVE, BUCKET)

    def _touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys: numbers below the bucket count."""
        return [r[0] for r in keys.select(self._bucket(F.col(self.key)).alias(BUCKET)).distinct().collect()]

    def _rewrite(self, rows: DataFrame, touched: list[int]) -> None:
        self._write(rows, self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int"))

    def upsert(self, new: DataFrame, at: str | None = None) -> int:
        """Merges rows by key as tables.upsert() does; returns the number of buckets rewritten. Rows with a null key are added."""
        touched = self._touched(new)
        if touched:
            self._rewrite(O.upsert(self._rows(touched), new, self.key, at), touched)
        return len(touched)

    def update(self, where: Column, values: dict[str, Column]) -> int:
        """Sets columns where a condition holds, in the buckets that have such rows; returns the number of rows changed. The
        key can't be set."""
        if self.key in values:
            raise ValueError("a key can't be set: delete and insert instead")
        hit = self._stored().where(where).groupBy(BUCKET).count().collect()
        touched = [r[BUCKET] for r in hit]
        if touched:
            self._rewrite(O.update_where(self._rows(touched), where, values), touched)
        return sum(r["count"] for r in hit)

    def delete(self, keys: DataFrame) -> int:
        """Deletes the rows of keys, a frame with the key column; returns the number of buckets rewritten."""
        keys = keys.select(self.key).distinct()
        touched = self._touched(keys)
        if touched:
            self._rewrite(O.delete(self._rows(touched), keys, self.key), touched)
        return len(touched)
