"""Stored tables: changes against plain dictionaries, and the files that they leave alone."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from pagelathe.sources.keyed import KeyedTable

KIND = "k string, v int, w string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def buckets(paths):
    return {p.split("__bucket=")[1].split("/")[0] for p in paths}


@pytest.fixture()
def table(spark, tmp_path):
    rows = [(f"k{i}", i, "old") for i in range(200)]
    return KeyedTable.create(spark.createDataFrame(rows, KIND), str(tmp_path / "t"), "k", buckets=8)


def test_changes(spark, table):
    """A row of upserts, updates and deletes against a dictionary; another handle on the folder reads the same."""
    want = {f"k{i}": (i, "old") for i in range(200)}
    r = random.Random(0)
    for turn in range(4):
        new = [(f"k{r.randrange(260)}", r.choice([None, 1000 + turn]), i) for i in range(15)]
        table.upsert(spark.createDataFrame(new, "k string, v int, at int"), at="at")
        for k, v, _ in new:
            want.setdefault(k, (None, None))
        for k in {k for k, _, _ in new}:
            v = [v for x, v, _ in new if x == k][-1]
            want[k] = (v if v is not None else want[k][0], want[k][1])
        n = table.update(F.col("v") % 7 == turn, {"w": F.lit(f"set{turn}")})
        hit = [k for k, (v, _) in want.items() if v is not None and v % 7 == turn]
        assert n == len(hit)
        want |= {k: (want[k][0], f"set{turn}") for k in hit}
        gone = [f"k{r.randrange(260)}" for _ in range(9)] + ["nobody", None]
        table.delete(spark.createDataFrame([(k,) for k in gone], "k string"))
        want = {k: v for k, v in want.items() if k not in gone}
        assert {x.k: (x.v, x.w) for x in table.read().collect()} == want
    again = KeyedTable(spark, table.path, table.schema, "k", 8)
    assert {x.k: (x.v, x.w) for x in again.read().collect()} == want
    some = next(iter(want))
    assert [(x.v, x.w) for x in again.get(some).collect()] == [want[some]] and again.get("nobody").collect() == []


@pytest.mark.parametrize("change", ["upsert", "delete", "update"])
def test_untouched_files_stay(spark, table, change):
    before = files(table.path)
    if change == "upsert":
        table.upsert(spark.createDataFrame([("k5", 7)], "k string, v int"))
    elif change == "delete":
        table.delete(spark.createDataFrame([("k5",)], "k string"))
    else:
        assert table.update(F.col("k") == "k5", {"v": F.lit(7)}) == 1
    after = files(table.path)
    same = {p for p in after if before.get(p) == after[p]}
    assert len(buckets(after)) == 8 and len(buckets(set(after) - same)) == 1 and buckets(set(before) - same) == buckets(set(after) - same)


def test_a_bucket_can_be_emptied(spark, table):
    table.delete(table.read().select("k"))
    assert table.read().collect() == [] and len(buckets(files(table.path))) == 8
    table.upsert(spark.createDataFrame([("new", 1, "x")], KIND))
    assert [tuple(x) for x in table.read().collect()] == [("new", 1, "x")]


def test_odd_rows(spark, tmp_path):
    """Null and repeated keys, changes that touch nothing, an empty table."""
    rows = [("a", 1, "x"), ("a", 2, None), (None, 3, "n")]
    t = KeyedTable.create(spark.createDataFrame(rows, KIND), str(tmp_path / "odd"), "k", buckets=3)
    none = spark.createDataFrame([], KIND)
    assert t.upsert(none) == 0 and t.delete(none) == 0 and t.update(F.col("v") > 99, {"w": F.lit("y")}) == 0
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted(rows, key=str)
    t.delete(spark.createDataFrame([("a",), (None,)], "k string"))
    assert [tuple(x) for x in t.read().collect()] == [(None, 3, "n")]
    with pytest.raises(ValueError):
        t.update(F.lit(True), {"k": F.lit("z")})
    empty = KeyedTable.create(none, str(tmp_path / "empty"), "k", buckets=2)
    assert empty.read().collect() == []
