"""Keyed state of streams: nulls, restarts with rows that wait, and stores that empty."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_hot_keys import FOLDS, KIND, T0, plain, rows_of

from pagelathe.operators import folds as S
from pagelathe.streaming.sources import run_available
from pagelathe.streaming.stateful import fold_stream


def write(spark, path, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, files=1):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", files).parquet(path)


@pytest.mark.parametrize("name", ["spacing", "admission", "control", "domain_breaker", "aimd"])
def test_nulls(spark, tmp_path, name):
    """Null times, values, statuses and keys: a null output, and the key's state as it was, in several micro-batches."""
    fold, columns, step = FOLDS[name]
    rows = rows_of(6, 240, ["a", "b", None], nulls=0.1)
    timed, timeless = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    for n in range(3):
        write(spark, str(tmp_path / "in"), timed[n * 80 : (n + 1) * 80] + timeless[n::3])
    got = run_available(fold_stream(source(spark, str(tmp_path / "in")), "k", "ts", "id", columns, fold, "out")).collect()
    assert len(got) == len(rows) and {r.id: r.out for r in got} == plain(rows, columns, step)


def test_restart_with_waiting_rows(spark, tmp_path):
    """Stopped while rows wait and taken up again: every row once, as if it had never been stopped."""
    rows = rows_of(8, 300, ["a", "b"])
    shuffled = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=r[2] % 7))
    base, path = str(tmp_path / "run"), str(tmp_path / "in")
    out = None
    for n in range(3):
        write(spark, path, shuffled[n * 100 : (n + 1) * 100])
        if n == 2:  # a row long after, of another key, lets all wait no longer
            write(spark, path, [("z", T0 + dt.timedelta(days=2), 999, True, 0.0, 0.0)])
            write(spark, path, [("z", T0 + dt.timedelta(days=3), 1000, True, 0.0, 0.0)])
        out = run_available(fold_stream(source(spark, path), "k", "ts", "id", [], S.spacing(3 * 10**6), "out", late="10 seconds"), base=base)
    got = out.where("id < 999").collect()
    assert len(got) == 300 and {r.id: r.out for r in got} == plain(rows, [], FOLDS["spacing"][2])


def test_the_store_empties(spark, tmp_path):
    """Once time has passed all ends, no row of state is left: of values, waiting rows and timers."""
    path = str(tmp_path / "in")
    for n in range(3):
        write(spark, path, [(f"k{n}-{i}", T0 + dt.timedelta(seconds=100 * n + i / 10), n * 50 + i, True, 0.0, 0.0) for i in range(50)])
    for days in (1, 2):  # rows that leave no state, but move the watermark
        write(spark, path, [("k", T0 + dt.timedelta(days=days), 1000 + days, None, None, None)])
    stream = fold_stream(source(spark, path), "k", "ts", "id", ["ok"], S.Fold("last bigint", (None,), "boolean", lambda s, c: ((int(c[0][-1]),), c[1].tolist()), lambda s: None if s[0] is None else s[0] + 10**6), "out", late="5 seconds")
    run = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert max(held) > 0 and held[-1] == 0
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
