"""Ordered computations against plain loops, and streams against batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagelathe.operators import folds as S
from pagelathe.operators.asof import as_of
from pagelathe.operators.sampling import categorical, weighted_choice
from pagelathe.streaming import windows as W
from pagelathe.streaming.sources import run_available
from pagelathe.streaming.stateful import fold_stream

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def events():
    r = random.Random(1)
    t, out = 0.0, []
    for i in range(600):
        t += r.choice([0.0, 0.05, 0.2, 0.4, 1.0, 3.0])
        out.append((r.choice("abc"), T0 + dt.timedelta(microseconds=round(t * 1e6)), i, r.random() < 0.5))
    return out


@pytest.fixture(scope="module")
def frame(spark, events):
    return spark.createDataFrame(events, "k string, ts timestamp, id long, ok boolean").withColumn("t", F.unix_micros("ts") / 1e6)


def loop(events, start, step):
    state, out = {}, {}
    for k, ts, i, ok in sorted(events, key=lambda e: (e[1], e[2])):
        s, out[i] = step(state.get(k, start()), (ts - T0).total_seconds(), ok)
        state[k] = s
    return out


def test_admission(frame, events):
    def step(s, t, _):
        s = [x for x in s if x > t - 1 + 1e-9]
        return (s + [t], True) if len(s) < 2 else (s, False)

    assert {r.id: r.ok for r in S.admit(frame, "k", "ts", "id", 2, 1.0).collect()} == loop(events, list, step)


def test_spacing(frame, events):
    step = lambda s, t, _: (t, True) if s is None or t - s >= 2 - 1e-9 else (s, False)
    assert {r.id: r.ok for r in S.spaced(frame, "k", "ts", "id", 2.0).collect()} == loop(events, lambda: None, step)


def test_waiting(frame, events):
    """Against a loop that keeps every slot ever taken."""

    def step(s, t, _):
        at = max([t, *s])
        while sum(at - 1 + 1e-9 < x <= at for x in s) >= 2:
            at = min(x for x in s if x > at - 1 + 1e-9) + 1
        return (s, None) if at - t >= 0.5 - 1e-6 else (s + [at], round((at - t) * 1e6))

    micros = frame.withColumn("t", F.unix_micros("ts"))
    got = {r.id: r.w for r in S.ordered(micros, "k", ["t", "id"], ["t"], S.waiting(10**6, 2, 500_000), "w").collect()}
    want = loop(events, list, step)
    assert got.keys() == want.keys() and all((got[i] is None) == (want[i] is None) and abs((got[i] or 0) - (want[i] or 0)) <= 2 for i in got)
    assert None in got.values() and any(got.values())


def test_decayed_mean_is_smoothing(spark, frame, events):
    """A sum over time buckets equals the fold, whatever the width of the buckets."""
    want = {}
    for k, ts, i, ok in sorted(events, key=lambda e: (e[1], e[2])):
        want[k] = want.get(k, 1.0) * 0.9 + 0.1 * ok
    for seconds in (1, 7, 3600):
        got = {r.k: r.score for r in S.decayed_mean(frame, "k", "ts", "id", F.col("ok").cast("int"), 0.9, 1.0, seconds).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_odd_rows(spark):
    """An empty table gives nothing; rows without a key are a chain of their own; repeated rows are taken one by one."""
    kind = "k string, ts timestamp, id long"
    assert S.admit(spark.createDataFrame([], kind), "k", "ts", "id", 2).collect() == []
    rows = [(k, T0 + dt.timedelta(seconds=s), i) for i, (k, s) in enumerate([(None, 0), (None, 0), ("a", 0), ("a", 0), (None, 5), ("", 0)])] + [("a", T0, 2)]
    got = sorted((r.id, r.ok) for r in S.spaced(spark.createDataFrame(rows, kind), "k", "ts", "id", 2.0).collect())
    assert got == [(0, True), (1, False), (2, False), (2, True), (3, False), (4, True), (5, True)]


def test_ema_and_pid(spark):
    rows = [("a", i, b, s) for i, (b, s) in enumerate([(0.0, 0.0), (0.06, 0.0), (0.5, 0.1), (0.9, 0.9), (0.0, 0.0), (0.2, 0.0)])]
    df = spark.createDataFrame(rows, "k string, bucket long, b double, s double")
    score, out = 0.0, []
    i_term = last = 0.0
    q = 1.0
    for _, _, b, s in rows:
        score = score * 0.7 + b * 0.3
        e = 0.05 - b
        if abs(e) >= 0.05:
            i_term = max(-2, min(2, i_term + e * 10))
            q = 0.1 if s > 0.7 else max(0.1, min(10, q + q * (0.5 * e + 0.1 * i_term + 0.05 * (e - last) / 10)))
            last = e
        out.append((score, q))
    ema = {r.bucket: r.score for r in S.ema(df, "k", "bucket", F.col("b")).collect()}
    rate = {r.bucket: r.qps for r in S.pid(df, "k", "bucket", F.col("b"), F.col("s")).collect()}
    assert all(abs(ema[i] - x) < 1e-12 and abs(rate[i] - y) < 1e-12 for i, (x, y) in enumerate(out))


def states(spark, make, oks, gap=1.0):
    df = spark.createDataFrame([("k", float(i) * gap, i, bool(ok)) for i, ok in enumerate(oks)], "k string, t double, id long, ok boolean")
    return [r.s for r in S.ordered(df, "k", ["t", "id"], ["t", "ok"], make, "s").orderBy("id").collect()]


def test_breakers(spark):
    assert states(spark, S.domain_breaker(2, 2.5, 1, 99), [0, 0, 1, 1, 1, 1, 0, 1, 0, 0]) == ["closed", "open", "open", "open", "closed", "closed", "closed", "closed", "closed", "open"]
    assert states(spark, S.domain_breaker(2, 1.5, 1, 99), [0, 1, 0, 1, 0, 1])[:3] == ["closed", "closed", "open"]  # a success does not clear failures before the state is set
    assert states(spark, S.domain_breaker(1, 1.5, 1, 99), [0, 0, 0, 0, 1]) == ["open", "open", "open", "open", "closed"]  # failed probe reopens
    assert states(spark, S.lazy_breaker(2, 1.5), [0, 0, 0, 0, 1]) == ["closed", "open", "open", "half_open", "closed"]
    assert states(spark, S.component_breaker(2, 1.5), [0, 0, 0, 0, 0, 0, 1]) == ["closed", "open", "open", "half_open", "half_open", "half_open", "closed"]


def test_increase_and_decrease(spark):
    df = spark.createDataFrame([("k", i, ok) for i, ok in enumerate([False] * 4 + [True] * 17 + [False])], "k string, id long, ok boolean")
    got = [r.n for r in S.ordered(df, "k", ["id"], ["ok"], S.aimd(), "n").orderBy("id").collect()]
    assert got[:4] == [5.0, 2.5, 2.5, 1.25] and got[11] == 1.75 and got[19] == 2.25 and got[-1] == 2.25


def test_as_of(spark):
    left = spark.createDataFrame([(i, "k", T0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 5, 10, 30])] + [(9, "z", T0)], "id long, k string, ts timestamp")
    right = spark.createDataFrame([("k", T0 + dt.timedelta(seconds=s), v) for s, v in [(1, "a"), (5, "b"), (9, "c")]], "k string, ts timestamp, v string")
    got = {r.id: r.v for r in as_of(left, right, "k", "ts", ["v"], 20).collect()}
    assert got == {0: None, 1: "b", 2: "c", 3: None, 9: None}


def test_draws(spark):
    df = spark.range(20000).select(F.lit("g").alias("g"), "id", F.when(F.col("id") == 7, 1e6).otherwise(1.0).alias("w"))
    assert weighted_choice(df, "g", "id", "w", 3).first().id == 7
    shares = {r.c: r["count"] for r in df.select(categorical(F.col("id"), {"x": 0.6, "y": 0.4}, 1).alias("c")).groupBy("c").count().collect()}
    assert abs(shares["x"] / 20000 - 0.6) < 0.02


@pytest.mark.parametrize("files", [1, None])
def test_streams_equal_batches(spark, frame, events, tmp_path, files):
    """The same rows in one micro-batch or in several that follow event time."""
    rows = sorted(events, key=lambda e: (e[1], e[2]))
    for n in range(4):
        part = spark.createDataFrame(rows[n * 150 : (n + 1) * 150], "k string, ts timestamp, id long, ok boolean").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, id long, ok boolean").option("maxFilesPerTrigger", files or 100).parquet(str(tmp_path / "in"))
    fold = lambda kind, columns=(): {r.id: r.out for r in run_available(fold_stream(stream, "k", "ts", "id", list(columns), kind, "out")).collect()}
    assert fold(S.admission(10**6, 2)) == {r.id: r.ok for r in S.admit(frame, "k", "ts", "id", 2, 1.0).collect()}
    assert fold(S.spacing(2 * 10**6)) == {r.id: r.ok for r in S.spaced(frame, "k", "ts", "id", 2.0).collect()}
    states = S.ordered(frame, "k", ["ts", "id"], ["t", "ok"], S.domain_breaker(4, 3.0, 2, 60.0), "s")
    assert fold(S.domain_breaker(4, 3e6, 2, 60e6), ["ok"]) == {r.id: r.s for r in states.collect()}
    counts = {(r.start, r.k): r.n for r in run_available(W.windowed(stream, ["k"], "1 minute"), "complete").collect()}
    expected = {(r.w.start, r.k): r["count"] for r in frame.groupBy(F.window("ts", "1 minute").alias("w"), "k").count().collect()}
    assert counts == expected


def test_disordered_rows_wait(spark, frame, events, tmp_path):
    """Rows that come up to 20 seconds late are folded in order; only the newest 20 seconds are still waiting at the end."""
    r = random.Random(5)
    rows = sorted(events, key=lambda e: e[1] + dt.timedelta(seconds=r.uniform(0, 18)))
    for n in range(6):
        spark.createDataFrame(rows[n * 100 : (n + 1) * 100], "k string, ts timestamp, id long, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, id long, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {x.id: x.out for x in run_available(fold_stream(stream, "k", "ts", "id", [], S.spacing(2 * 10**6), "out", late="20 seconds")).collect()}
    want = {x.id: x.ok for x in S.spaced(frame, "k", "ts", "id", 2.0).collect()}
    newest = max(e[1] for e in events)
    assert all(got[i] == want[i] for i in got)
    assert {e[2] for e in events if e[1] <= newest - dt.timedelta(seconds=20)} <= set(got) < set(want)


def test_state_leaves_the_store(spark, tmp_path):
    """Each key is seen once; after its two seconds it is gone, so the store holds the last keys and not all."""
    for n in range(4):
        rows = [(f"k{n}-{i}", T0 + dt.timedelta(seconds=100 * n + i / 100), i) for i in range(100)]
        spark.createDataFrame(rows, "k string, ts timestamp, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = fold_stream(stream, "k", "ts", "id", [], S.spacing(2 * 10**6), "ok")
    run = out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert max(held) <= 200 and held[-1] <= 100


def test_late_rows_are_dropped(spark, tmp_path):
    """In append mode a row later than the watermark allows is not counted; it needs a batch after the advance."""
    path = str(tmp_path / "in")
    for n, minutes in enumerate([0, 60, 120, 1, 180, 240]):
        spark.createDataFrame([("k", T0 + dt.timedelta(minutes=minutes))], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.start.replace(tzinfo=dt.timezone.utc): r.n for r in run_available(W.windowed(stream, ["k"], "10 minutes", late="5 minutes")).collect()}
    assert got[T0] == 1 and len(got) >= 3


def test_approximate_dedup_keeps_every_key(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("k", i % 5, T0 + dt.timedelta(seconds=i)) for i in range(50)], "k string, id long, ts timestamp").write.parquet(path)
    stream = spark.readStream.schema("k string, id long, ts timestamp").parquet(path)
    assert sorted(r.id for r in run_available(W.dedup_approximate(stream, "id")).collect()) == [0, 1, 2, 3, 4]


def test_dns_uses_every_event(spark, tmp_path):
    """Every event is answered, by the last one of its domain before it; events at the same time follow their ids."""
    from pagelathe.plans import catalog
    from pagelathe.sources import tables as T

    r, t, rows = random.Random(3), dt.datetime(2024, 1, 1), []
    for i in range(400):
        t += dt.timedelta(minutes=r.choice([0, 0, 1, 5, 20, 45]))
        rows.append((i, t, r.randrange(20), r.choice(["click", "error"]), r.uniform(0, 200), '{"k": 1}'))
    spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).write.parquet(f"{tmp_path}/events.parquet")
    last, expected = {}, {}
    for e in sorted(T.fetch_log(spark, str(tmp_path)).collect(), key=lambda e: (e.ts, e.event_id)):
        seen = last.get(e.domain)
        age = (e.ts - seen.ts).total_seconds() if seen else 1e9
        expected[e.event_id] = (seen.latency_ms < 10000 if age < 6 * 3600 else None, age > 5 * 3600)
        last[e.domain] = e
    assert {e.event_id: (e.up, e.refresh) for e in catalog.queries()["st_dns"](spark, str(tmp_path)).collect()} == expected
    assert len(expected) == 400 and len(set(expected.values())) >= 4
