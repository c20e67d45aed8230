"""Streams over tables of files, and runs to the end of what is there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one on a local master only: on a
    cluster each executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="pagelathe-stream-")


def stream_table(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A Parquet table as a stream; files bounds the files of a micro-batch. Zone-less timestamps are taken as UTC."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    df = reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    zoneless = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def new_folder(spark: SparkSession) -> str:
    """A folder in the shared one that no other call returns."""
    return f"{shared_dir(spark)}/pagelathe/stream-{uuid.uuid4().hex}"


def run_available(df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, base: str | None = None, poll: str | None = None, number: str | None = None) -> DataFrame:
    """Runs a stream over all that is available and returns what it has written so far.

    In complete mode the table of the last micro-batch replaces the one before; in append mode a batch's rows go to a
    folder of the batch's own, so a batch that is run again writes the same rows once. A run with the base of an earlier one
    goes on from its checkpoint. poll asks the source at intervals, as a service would, until nothing is left. number, in
    append mode, adds a column of that name with the micro-batch of each row.
    """
    spark = df.sparkSession
    base = base or new_folder(spark)
    out = f"{base}/out"

    def write(batch: DataFrame, nth: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/__batch={nth}")
        if each:
            each(batch, nth)

    writer = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
    if poll:
        running = writer.trigger(processingTime=poll).start()
        running.processAllAvailable()
        running.stop()
    else:
        writer.trigger(availableNow=True).start().awaitTermination()
    if mode == "complete":
        return spark.read.schema(df.schema).parquet(out)
    found = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__batch", T.LongType())])).parquet(out)
    return found.select(*df.columns, *([F.col("__batch").alias(number)] if number else []))
