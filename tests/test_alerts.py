"""Range vectors and rules against an evaluator that looks at every sample at every step."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagelathe.operators import alerts as A
from pagelathe.operators import scans

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
S0 = int(T0.timestamp())


def window(samples, step):
    end = step * 60
    return sorted((t, v) for t, v in samples if end - 300 < t <= end)


def plain_rate(samples, step):
    w = window(samples, step)
    if len(w) < 2 or w[0][0] == w[-1][0]:
        return None
    up = sum(b - a if b >= a else b for (_, a), (_, b) in zip(w, w[1:]))
    span = w[-1][0] - w[0][0]
    gap = span / (len(w) - 1)
    lead, tail = w[0][0] - (step * 60 - 300), step * 60 - w[-1][0]
    lead, tail = (gap / 2 if x >= gap * 1.1 else x for x in (lead, tail))
    if up > 0:
        lead = min(lead, span * w[0][1] / up)
    return up * (span + lead + tail) / span / 300


def series(seed, n=150, counter=True):
    """Times in seconds, at whole and broken seconds, in bursts and after long quiet; counters restart at times."""
    r, t, v, out = random.Random(seed), 0.0, 0.0, []
    for _ in range(n):
        t += r.choice([1, 7.5, 20, 60, 60, 90, 400, 2000])
        v = 0.0 if counter and r.random() < 0.08 else v + r.choice([0, 1, 5, 30]) if counter else r.choice([0.0, 0.4, 0.6, 0.9])
        out.append((S0 + t, v))
    return out


def frame(spark, rows, kind):
    at = lambda t: None if t is None else dt.datetime.fromtimestamp(t, dt.timezone.utc)
    return spark.createDataFrame([(*x, at(t), v) for *x, t, v in rows], f"{kind}, ts timestamp, value double")


@pytest.mark.parametrize("bucket", [120, 10**6])
def test_rate(spark, monkeypatch, bucket):
    monkeypatch.setattr(scans, "BUCKET_SECONDS", bucket)
    made = {(s, label): series(hash_) for hash_, (s, label) in enumerate([("a", "x"), ("b", "x"), ("a", None), ("c", "y")])}
    made = {(s + str(label), label): v for (s, label), v in made.items()}
    rows = [(s, label, t, v) for (s, label), v in made.items() for t, v in v]
    got = {(r.series, r.label, r.step): r.value for r in A.rate(frame(spark, [*rows, ("ax", "x", None, 1.0), ("ax", "x", S0 + 5.0, None)], "series string, label string")).collect()}
    steps = range(S0 // 60, S0 // 60 + 2000)
    want = {(s, label, step): plain_rate(v, step) for (s, label), v in made.items() for step in steps}
    want = {k: v for k, v in want.items() if v is not None}
    assert got.keys() == want.keys() and len(want) > 300
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_last_value(spark):
    made = {label: series(i, counter=False) for i, label in enumerate(["x", None, "z"])}
    got = {(r.label, r.step): r.value for r in A.last_value(frame(spark, [(label, t, v) for label, s in made.items() for t, v in s], "label string")).collect()}
    want = {(label, step): w[-1][1] for label, s in made.items() for step in range(S0 // 60, S0 // 60 + 2000) if (w := window(s, step))}
    assert got == want


@pytest.mark.parametrize("rule,op,limit,minutes", A.RULES)
def test_rules_hold(spark, rule, op, limit, minutes):
    """Against a walk over all steps; a step without a value ends a span."""
    r = random.Random(minutes)
    levels = [float(limit), limit + 0.1, limit + 1.0, limit - 0.1, 0.0]
    values, step = [], 0
    for _ in range(300):
        step += r.choice([1] * 12 + [2, 9])
        values.append((r.choice("ab"), step, r.choice(levels) if r.random() < 0.15 else levels[1] if op == ">" else levels[0] if op == "==" else levels[3]))
    hits = {">": lambda v: v > limit, "<": lambda v: v < limit, "==": lambda v: v == limit}[op]
    want = set()
    for label in "ab":
        on = {s: v for x, s, v in values if x == label and hits(v)}
        for s in on:
            if s - 1 not in on:
                end = s
                while end + 1 in on:
                    end += 1
                if end - s >= minutes:
                    span = [on[i] for i in range(s, end + 1)]
                    want.add((rule, label, s, s + minutes, end, min(span) if op == "<" else max(span)))
    got = A.firing(spark.createDataFrame(values, "label string, step long, value double"), rule).collect()
    assert {tuple(x) for x in got} == want


def test_failure_ratio(spark):
    rows = [("failed", "x", 1, 1.0), ("done", "x", 1, 3.0), ("done", "x", 2, 3.0), ("failed", "x", 3, 0.0), ("failed", "y", 1, 2.0)]
    got = A.failure_ratio(spark.createDataFrame(rows, "series string, label string, step long, value double"), "failed").collect()
    assert {tuple(x) for x in got} == {("x", 1, 0.25), ("y", 1, 1.0)}


def test_empty(spark):
    none = spark.createDataFrame([], "series string, label string, ts timestamp, value double")
    assert A.rate(none).collect() == [] and A.firing(A.last_value(none), "NoWorkers").collect() == []
    assert A.failure_ratio(A.rate(none.withColumn("value", F.col("value"))), "failed").collect() == []
