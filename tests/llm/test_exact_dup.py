from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagelathe.llm import exact_dup as ed

UP = str.maketrans(ed.UPPER, ed.LOWER)


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    pick = {"min": min, "max": max}[keep]
    out = []
    for i, t in rows:
        own = groups[(t or "").translate(UP)]
        some = [x for x in own if x is not None]
        best = pick(some) if some else None
        out.append((i, best, len(own), i == best, hashlib.sha256((t or "").translate(UP).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, "ÀB"), (5, "àb"), (6, "Àb"), (7, None), (8, ""), (9, "x" * 200000), (10, "X" * 200000), (11, "K"), (12, "K"), (12, "K"), (None, "abc"), (None, "lonely"), (None, "lonely")]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("copies", [1, 3])
def test_equals_brute_force(spark, keep, copies):
    rows = ROWS * copies
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], "doc_id long, text string, h string, norm string")
    assert sorted((tuple(r) for r in ed.exact_groups(df, keep=keep).collect()), key=str) == brute(rows, keep)


def test_collisions_are_told_apart(spark, monkeypatch):
    """All texts are given one hash; groups must still be those of equal bytes."""
    monkeypatch.setattr(ed.F, "md5", lambda c: F.lit("00" * 16))
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted((tuple(r) for r in ed.exact_groups(df, keep="max").collect()), key=str) == brute(ROWS, "max")


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ed.exact_groups(df).collect() == [] and ed.drop_exact(df).collect() == []


@pytest.mark.parametrize("rows", [ROWS, ROWS * 2, [(i, t) for i, t in ROWS if i not in (None, 12)]])
def test_drop_leaves_one_of_each(spark, rows):
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, keep_id string")
    got = ed.drop_exact(df).collect()
    expected = {}
    for i, _, _, _, sha in brute(rows, "min"):
        if i is not None or sha not in expected:
            expected[sha] = i if expected.get(sha) is None else min(expected[sha], i)
    assert sorted((str(r.doc_id), hashlib.sha256((r.text or "").translate(UP).encode()).hexdigest()) for r in got) == sorted((str(i), s) for s, i in expected.items())
    assert df.columns == ["doc_id", "text", "keep_id"]


def test_one_id_on_several_texts(spark):
    """Texts are judged one by one: a text that stands nowhere else is not lost with a copy of the same id."""
    rows = [(1, "x"), (2, "X"), (2, "unique"), (2, "unique"), (3, "unique"), (4, "y"), (4, "z"), (5, "Y"), (None, "n"), (None, "N"), (None, "x")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, norm string")
    got = sorted(((r.doc_id, r.text.lower()) for r in ed.drop_exact(docs).collect()), key=str)
    assert got == sorted([(1, "x"), (2, "unique"), (4, "y"), (4, "z"), (None, "n")], key=str)
