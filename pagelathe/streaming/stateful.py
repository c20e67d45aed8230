"""Ordered per-key folds over streams, with the state machines of pagelathe.operators.folds.

Rows of a key are folded in event-time order. A row waits until no earlier one can come: until late has passed since the key's
newest row or the watermark has reached it. Rows later than the watermark are dropped, as Spark does for every stateful
operator. A key's fold is one value, its waiting rows are a list that is touched only while rows wait, and an event-time
timer wakes it when one of them is due, when its fold has expired or when it has been idle; then it leaves the store. So the
store holds live keys only, and a batch reads and writes the keys that it has rows of. State is kept by RocksDB.

A row whose time or any of whose columns is null (or NaN) is given out at once with a null output and leaves the state alone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagelathe.operators.folds import Fold

_INTERVAL = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(interval: str) -> int:
    n, unit = interval.split()
    return int(dt.timedelta(seconds=float(n) * _INTERVAL[unit.rstrip("s")]) / dt.timedelta(microseconds=1))


def _plain(values: list) -> list:
    return [v.item() if hasattr(v, "item") else v for v in values]


class Folding(StatefulProcessor):
    """Keeps (fold state, time of the newest row, waiting rows, time of the timer) for each key.

    Frames have the columns k (key), t (microseconds), v0 (order) and v1, ... (what the fold takes), of the given kinds from
    v0 on; outputs are named names: key, order, out.
    """

    def __init__(self, fold: Fold, kinds: list[str], names: list[str], late: int, idle: int):
        self.fold, self.kinds, self.names, self.late, self.idle = fold, kinds, names, late, idle
        self.columns = ["t", *(f"v{i}" for i in range(len(kinds)))]
        # a value of another type than its field's would be stored as null
        self.exact = [float if x.endswith(" double") else lambda v: v for x in fold.state.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("fold", f"{self.fold.state}, newest bigint, waiting bigint, wake bigint")
        self.rows = handle.getListState("waiting", "t bigint, " + ", ".join(f"v{i} {k}" for i, k in enumerate(self.kinds)))

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))[self.columns]
        lacking = fresh[["t", *self.columns[2:]]].isna().any(axis=1).to_numpy()
        if lacking.any():
            gone = fresh[lacking]
            yield self._frame(key, gone, [None] * len(gone))
            fresh = fresh[~lacking]
        if len(fresh):
            yield from self._advance(key, fresh.astype({"t": "int64"}), timerValues, None)

    def _frame(self, key: Any, rows: pd.DataFrame, results: list) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(self.names, ([key[0]] * len(rows), rows["v0"].to_numpy(), results), strict=True)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, None, timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, key: Any, fresh: pd.DataFrame | None, timers: Any, expired: int | None) -> Iterator[pd.DataFrame]:
        held = self.now.get()
        n = len(self.exact)
        if held is None:
            if fresh is None:
                return
            now, newest, waiting, wake = self.fold.start, None, 0, None
        else:
            now, (newest, waiting, wake) = tuple(held[:n]), held[n:]
        if expired is not None and wake == expired:
            wake = None
        rows = pd.DataFrame(list(self.rows.get()), columns=self.columns) if waiting else None
        rows = fresh if rows is None else rows if fresh is None else pd.concat([rows, fresh])
        if fresh is not None:
            newest = max(int(fresh["t"].max()), newest if newest is not None else 0)
        mark = timers.getCurrentWatermarkInMs()
        watermark = mark * 1000 if mark > 0 else None
        left = 0
        if rows is not None:
            rows = rows.sort_values(["t", "v0"], kind="stable")
            until = max(x for x in (watermark, newest - self.late) if x is not None)
            due = int(np.searchsorted(rows["t"].to_numpy(dtype="int64"), until, "right"))
            ready, rows = rows[:due], rows[due:]
            left = len(rows)
            if len(ready):
                now, results = self.fold.run(now, [ready["t"].to_numpy(dtype="int64"), *(ready[c].to_numpy() for c in self.columns[2:])])
                yield self._frame(key, ready, results)
        if left:
            self.rows.put([tuple(_plain(r)) for r in rows.itertuples(index=False, name=None)])
        elif waiting:
            self.rows.clear()
        ends = self.fold.expires(now)
        ends = newest + self.idle if ends is None else max(ends, newest)
        if not left and watermark is not None and ends <= watermark:
            self.now.clear()
            if wake is not None:
                self.handle.deleteTimer(wake)
            return
        due_at = max(int(rows["t"].min()) // 1000 - 1 if left else ends // 1000 + 1, mark + 1)
        if wake is None or due_at < wake:  # a timer that comes too early sets the next one
            if wake is not None:
                self.handle.deleteTimer(wake)
            wake = due_at
            self.handle.registerTimer(wake)
        self.now.update((*(None if v is None else f(v) for f, v in zip(self.exact, now, strict=True)), newest, left, wake))


def use_rocksdb(spark: SparkSession) -> None:
    """RocksDB for the state of streams that start from here on: lists and timers need it."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def fold_stream(stream: DataFrame, key: str, ts: str, order: str, columns: list[str], fold: Fold, out: str, late: str = "0 seconds", idle: str = "30 days") -> DataFrame:
    """(key, order, out): fold over each key's rows by ts, then order.

    The fold takes the time in microseconds and then columns, so its spans are in microseconds too. late is how far a row may
    come behind the newest one; idle is how long a key whose fold has no end of its own is kept after its newest row. A key
    that comes back later starts anew.
    """
    use_rocksdb(stream.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    values = [order, *columns]
    processor = Folding(fold, [types[c] for c in values], [key, order, out], _micros(late), _micros(idle))
    # plain names: those that begin with an underscore don't reach the frames
    named = [F.col(key).alias("k"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("t"), *(F.col(c).alias(f"v{i}") for i, c in enumerate(values))]
    picked = stream.select(*named).withWatermark("ts", late)
    return picked.groupBy("k").transformWithStateInPandas(processor, f"`{key}` {types[key]}, `{order}` {types[order]}, `{out}` {fold.kind}", "append", "eventTime")
