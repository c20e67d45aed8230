"""Folds and windows with rows of one key in many tasks, and with nulls in any column."""

from __future__ import annotations

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelathe.operators import folds as S
from pagelathe.operators import scans
from pagelathe.operators.asof import as_of

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
KIND = "k string, ts timestamp, id long, ok boolean, x double, y double"


# ---- one step of each state machine, row by row


def admission(us, most):
    def step(s, t, *_):
        s = [x for x in s or [] if x > t - us]
        return (s + [t], True) if len(s) < most else (s, False)

    return step


def waiting(us, most, timeout):
    def step(s, t, *_):
        s = s or []
        at = max(t, s[-1] if s else t, s[-most] + us if len(s) >= most else t)
        return (s + [at], at - t) if at - t < timeout else (s, None)

    return step


def smoothing(keep):
    def step(s, t, ok, x, y):
        s = (s or 0.0) * keep + x * (1 - keep)
        return s, s

    return step


def control(s, t, ok, x, y):
    smooth, i, last, q = s or (0.0, 0.0, 0.0, 1.0)
    smooth = smooth * 0.9 + x * (1 - 0.9)
    error = 0.05 - smooth
    if abs(error) >= 0.05:
        i = max(-2.0, min(2.0, i + error * 10.0))
        q = 0.1 if y > 0.7 else max(0.1, min(10.0, q + (0.5 * error + 0.1 * i + 0.05 * (error - last) / 10.0) * q))
        last = error
    return (smooth, i, last, q), q


def domain_breaker(threshold, cooldown, probes, forget):
    def step(s, t, ok, *_):
        state, failures, opened, tried, at = s or (None, 0, 0.0, 0, None)
        if state == "open":
            if t - opened < cooldown:
                return (state, failures, opened, tried, at), "open"
            state, tried = "half_open", 0
        elif state == "half_open":
            tried += 1
            if tried > probes:
                return (state, failures, opened, tried, at), "half_open"
        if ok:
            if state == "half_open":
                state, failures, tried = "closed", 0, 0
            elif state == "closed":
                failures = 0
        elif state == "half_open":
            state, opened = "open", t
        else:
            failures = 1 if at is not None and t - at > forget else failures + 1
            at = t
            if failures >= threshold:
                state, opened = "open", t
        return (state, failures, opened, tried, at), state or "closed"

    return step


def lazy_breaker(threshold, cooldown):
    def step(s, t, ok, *_):
        state, failures, opened = s or ("closed", 0, 0.0)
        failures = 0 if ok else failures + 1
        if state == "closed" and failures >= threshold:
            state, opened = "open", t
        elif state == "open":
            if t - opened >= cooldown:
                state = "half_open"
        elif state == "half_open" and failures == 0:
            state = "closed"
        return (state, failures, opened), state

    return step


def component_breaker(threshold, cooldown):
    def step(s, t, ok, *_):
        state, failures, opened = s or ("closed", 0, 0.0)
        if state == "open" and t - opened >= cooldown:
            state, failures = "half_open", 0
        if ok:
            state, failures = "closed", 0
        else:
            failures += 1
            if failures >= threshold and state == "closed":
                state, opened = "open", t
        return (state, failures, opened), state

    return step


def aimd(s, t, ok, *_):
    now, good, bad = s or (5.0, 0, 0)
    if ok:
        good, bad = good + 1, 0
        if good >= 8:
            now, good = min(5.0, now + 0.5), 0
    else:
        good, bad = 0, bad + 1
        if bad >= 2:
            now, bad = max(1.0, now / 2), 0
    return (now, good, bad), now


S1 = 10**6
#: name: (fold over microseconds, its columns after the time, one step)
FOLDS = {
    "admission": (S.admission(5 * S1, 2), [], admission(5 * S1, 2)),
    "admission3": (S.admission(40 * S1, 3), [], admission(40 * S1, 3)),
    "spacing": (S.spacing(3 * S1), [], lambda s, t, *_: (t, True) if s is None or t - s >= 3 * S1 else (s, False)),
    "spacing_long": (S.spacing(300 * S1), [], lambda s, t, *_: (t, True) if s is None or t - s >= 300 * S1 else (s, False)),
    "spacing_none": (S.spacing(0), [], lambda s, t, *_: (t, True)),
    "waiting": (S.waiting(4 * S1, 2, 3 * S1), [], waiting(4 * S1, 2, 3 * S1)),
    "smoothing": (S.smoothing(0.7), ["x"], smoothing(0.7)),
    "control": (S.control(keep=0.9), ["x", "y"], control),
    "domain_breaker": (S.domain_breaker(3, 5.0 * S1, 2, 9.0 * S1), ["ok"], domain_breaker(3, 5.0 * S1, 2, 9.0 * S1)),
    "domain_breaker_one": (S.domain_breaker(1, 2.0 * S1, 1, 1.0 * S1), ["ok"], domain_breaker(1, 2.0 * S1, 1, 1.0 * S1)),
    "lazy_breaker": (S.lazy_breaker(3, 5.0 * S1), ["ok"], lazy_breaker(3, 5.0 * S1)),
    "component_breaker": (S.component_breaker(2, 5.0 * S1), ["ok"], component_breaker(2, 5.0 * S1)),
    "aimd": (S.aimd(), ["ok"], aimd),
}


def plain(rows, columns, step):
    """Output by id; a row with a null time or a null among columns has a null output and no effect."""
    state, out = {}, {}
    for k, ts, i, ok, x, y in sorted(rows, key=lambda r: (r[1] or T0, r[2])):
        if ts is None or (ok is None and "ok" in columns) or (x is None and "x" in columns) or (y is None and "y" in columns):
            out[i] = None
            continue
        state[k], out[i] = step(state.get(k), round((ts - T0).total_seconds() * 1e6) + round(T0.timestamp()) * S1, ok, x, y)
    return out


def rows_of(seed, n, keys, nulls=0.0, good=0.5):
    r, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += r.choice([0.0, 0.05, 0.2, 0.4, 1.0, 3.0]) * r.choice([1, 1, 1, 8])
        values = [T0 + dt.timedelta(microseconds=round(t * 1e6)), r.random() < good, float(r.random() < 0.2), r.random()]
        ts, ok, x, y = (None if r.random() < nulls else v for v in values)
        rows.append((r.choice(keys), ts, i, ok, x, y))
    return rows


def folded(spark, rows, name):
    fold, columns, _ = FOLDS[name]
    df = spark.createDataFrame(rows, KIND).withColumn("t", F.unix_micros("ts"))
    return S.ordered(df, "k", ["t", "id"], ["t", *columns], fold, "out")


@pytest.mark.parametrize("name", FOLDS)
@pytest.mark.parametrize("good", [0.15, 0.5, 0.9])
def test_run_equals_steps(name, good):
    """Whole runs and any division of them, without Spark."""
    fold, columns, step = FOLDS[name]
    for seed in range(25):
        rows = rows_of(seed, 200, ["k"], good=good)
        want = list(plain(rows, columns, step).values())
        t = np.array([round((x[1] - T0).total_seconds() * 1e6) + round(T0.timestamp()) * S1 for x in rows])
        values = {"ok": np.array([x[3] for x in rows]), "x": np.array([x[4] for x in rows]), "y": np.array([x[5] for x in rows])}
        arrays = [t, *(values[c] for c in columns)]
        r = random.Random(seed)
        for cuts in ([], sorted(r.sample(range(200), 5)), list(range(0, 200, 3))):
            state, got = fold.start, []
            for a, b in zip([0, *cuts], [*cuts, 200], strict=True):
                before = state
                state, out = fold.run(state, [x[a:b] for x in arrays])
                got += out
                if fold.brief:
                    pieces, jumped = fold.brief([x[a:b] for x in arrays]), before
                    for i in range(0, len(pieces[0]), 2):
                        jumped = fold.jump(jumped, [p[i : i + 2] for p in pieces])
                    assert jumped == state
            assert got == want


@pytest.mark.parametrize("name", FOLDS)
def test_hot_key(spark, monkeypatch, name):
    """All rows but a few under one key, in parts of 100: the results are those of the steps, and no task has much more."""
    monkeypatch.setattr(S, "CHUNK_ROWS", 100)
    monkeypatch.setattr(S, "PIECE_ROWS", 16)
    rows = rows_of(1, 1500, ["hot"] * 20 + ["a", "b", None, "z"], nulls=0.02)
    got = folded(spark, rows, name).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 1500 and {r.id: r.out for r in got} == plain(rows, FOLDS[name][1], FOLDS[name][2])
    sizes = np.bincount([r.task for r in got])
    hot = len({r.task for r in got if r.k == "hot"})
    assert hot >= 8 and sizes.max() <= 500  # a few parts may meet in one task


def test_hot_instant(spark, monkeypatch):
    """Rows of one key at one time are cut by their ids."""
    monkeypatch.setattr(S, "CHUNK_ROWS", 50)
    rows = [("k", T0, i, i % 3 == 0, 0.0, 0.0) for i in range(600)]
    for name in ("admission", "spacing", "aimd", "lazy_breaker"):
        assert {r.id: r.out for r in folded(spark, rows, name).collect()} == plain(rows, FOLDS[name][1], FOLDS[name][2])


@pytest.mark.parametrize("name", FOLDS)
def test_nulls(spark, name):
    """Null times, values, statuses and keys, batch; an empty table gives nothing."""
    rows = rows_of(2, 300, ["a", "b", None], nulls=0.15)
    assert {r.id: r.out for r in folded(spark, rows, name).collect()} == plain(rows, FOLDS[name][1], FOLDS[name][2])
    only = [("n", None, i, None, None, None) for i in range(3)]
    assert [r.out for r in folded(spark, only, name).collect()] == [None] * 3
    assert folded(spark, [], name).collect() == []


def test_ten_million_rows_of_a_breaker():
    """Breakers and concurrency take a step a change of state: ten million rows of one key in a few seconds."""
    r = np.random.default_rng(0)
    t = np.cumsum(r.exponential(0.5, 10**7)) + 1.7e9
    ok = r.random(10**7) < 0.9
    begin = time.time()
    for fold in (S.domain_breaker(4, 7200.0, 3, 86400.0), S.lazy_breaker(4, 7200.0), S.component_breaker(3, 3600.0)):
        state, out = fold.run(fold.start, [t, ok])
        assert len(out) == 10**7
    assert time.time() - begin < 40


# ---- windows


def by_key(rows):
    """A key's rows in order, rows with a null time first."""
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[2])):
        out.setdefault(r[0], []).append(r)
    return out.values()


@pytest.fixture(scope="module")
def skewed():
    return rows_of(4, 700, ["hot"] * 20 + ["a", None], nulls=0.05)


@pytest.mark.parametrize("seconds", [1, 30, 10**6])
def test_scans(spark, skewed, seconds):
    """Whatever the width of the buckets."""
    df = spark.createDataFrame(skewed, KIND)
    got = scans.scan(df, "k", "ts", ["id"], nth="nth", seconds=seconds, x_before=F.col("x"), good=F.when(F.col("ok"), F.struct("id", "ts"))).collect()
    want = {}
    for rows in by_key(skewed):
        x = good = None
        for n, r in enumerate(rows, 1):
            want[r[2]] = (n, x, good)
            x = r[4] if r[4] is not None else x
            good = r[2] if r[3] else good
    assert {r.id: (r.nth, r.x_before, r.good and r.good.id) for r in got} == want and len(got) == len(skewed)
    got = scans.streak(df, "k", "ts", ["id"], F.col("ok"), seconds=seconds).collect()
    want = {}
    for rows in by_key(skewed):
        n = 0
        for r in rows:
            want[r[2]] = n = 0 if r[3] else n + 1
    assert {r.id: r.streak for r in got} == want and len(got) == len(skewed)


@pytest.mark.parametrize("seconds", [0.05, 1, 20, 10**6])
def test_arrivals(spark, skewed, seconds):
    got = scans.arrivals(spark.createDataFrame(skewed, KIND), "k", "ts", seconds).collect()
    span = dt.timedelta(seconds=seconds)
    want = {r[2]: None if r[1] is None else sum(o[0] == r[0] and o[1] is not None and r[1] - span <= o[1] < r[1] for o in skewed) for r in skewed}
    assert {r.id: r.n for r in got} == want and len(got) == len(skewed)


def test_as_of_with_a_hot_key(spark, skewed, monkeypatch):
    monkeypatch.setattr(scans, "BUCKET_SECONDS", 7)
    left, right = [r for r in skewed if r[2] % 2], [r for r in skewed if not r[2] % 2]
    a = spark.createDataFrame(left, KIND).select("id", "k", "ts")
    b = spark.createDataFrame(right, KIND).select("k", "ts", F.col("id").alias("hit"), "ok")
    want = {}
    for r in left:
        near = [(o[1], o[2]) for o in right if o[0] == r[0] and r[1] and o[1] and r[1] - dt.timedelta(seconds=40) < o[1] <= r[1]]
        want[r[2]] = max(near)[1] if near else None
    assert {r.id: r.hit for r in as_of(a, b, "k", "ts", ["hit", "ok"], 40).collect()} == want


@pytest.mark.parametrize("make", [lambda d: scans.scan(d, "k", "ts", ["id"], nth="n", seconds=20, v=F.col("x")), lambda d: scans.streak(d, "k", "ts", ["id"], F.col("ok"), seconds=20), lambda d: scans.arrivals(d, "k", "ts", 20)])
def test_one_key_is_many_tasks(spark, make):
    """With all rows under one key the largest task holds a few buckets; an empty table gives nothing."""
    rows = rows_of(9, 2000, ["hot"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = make(spark.createDataFrame(rows, KIND)).withColumn("task", F.spark_partition_id()).collect()
        sizes = np.bincount([r.task for r in got])
        assert len(got) == 2000 and sizes.max() < 400 and (sizes > 0).sum() > 15
        assert make(spark.createDataFrame([], KIND)).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
