"""As-of lookups: the latest row of the other side at or before a time, within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.operators.scans import scan


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, columns: list[str], seconds: float) -> DataFrame:
    """left with columns and matched_ts of the last right row of its key with ts in (left ts - seconds, left ts].

    Both sides are scanned together by key and time and the last right row is carried along, so nothing is multiplied: no
    range join, and a hot key is spread over its time buckets. Of right rows of one time that with the greatest columns counts.
    Without a match, and for a null time, the columns are null; a null key matches null keys.
    """
    carried = F.struct(F.col(ts).alias("matched_ts"), *columns)
    a = left.withColumns({"__side": F.lit(1), "__r": F.lit(None).cast(right.select(carried.alias("c")).schema["c"].dataType)})
    b = right.where(F.col(ts).isNotNull()).select(key, ts, F.lit(0).alias("__side"), carried.alias("__r"))
    both = scan(a.unionByName(b, allowMissingColumns=True), key, ts, ["__side", "__r"], __last=F.col("__r")).where("__side = 1")
    near = F.unix_micros(ts) - F.unix_micros("__last.matched_ts") < int(seconds * 1e6)
    return both.select(*left.columns, *(F.when(near, F.col(f"__last.{c}")).alias(c) for c in ["matched_ts", *columns]))
