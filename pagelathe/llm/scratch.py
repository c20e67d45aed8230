"""Tables written in the cluster's shared folder, and joins whose broadcast is checked for size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has at most so many rows of one id; above it both sides are shuffled.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, as in tests, a temporary one on a local master
    only: on a cluster each executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        if folder.isDefined():
            return folder.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagelathe-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_dir(spark).rstrip('/')}/pagelathe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs no upstream work."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard_path(spark: SparkSession, path: str | None) -> None:
    """Deletes a folder that new_path() has named."""
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame | None) -> None:
    """Deletes what written() has stored for df; only for tables that no later plan reads."""
    if df is not None:
        discard_path(df.sparkSession, getattr(df, "_scratch_path", None))


def sized(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """df for the small side of a join: broadcast while its counted rows stay within most, else left to the planner."""
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most is None else most) else df


def by_ids(df: DataFrame, key: str, ids: DataFrame, how: str, rows: int | None = None) -> DataFrame:
    """left_semi or left_anti join of df with the one column of ids.

    ids is broadcast while its counted rows stay within BROADCAST_ROWS (about 8 bytes each); beyond, both sides shuffle.
    """
    ids = ids.toDF("__pl_id")
    if rows is None:
        rows = ids.count()
    right = F.broadcast(ids) if rows <= BROADCAST_ROWS else ids.hint("merge")
    return df.join(right, df[key] == right["__pl_id"], how)
