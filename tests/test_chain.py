"""Chains of steps over requests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pagelathe.operators import chain as C

T0 = dt.datetime(2024, 1, 1)


def test_steps_run_in_order(spark):
    add = lambda n: lambda df: df.withColumn("seen", F.concat("seen", F.lit(n)))
    one = C.Chain(add("a"))
    two = one.add(add("b"), add("c"))
    df = spark.createDataFrame([("",)], "seen string")
    assert one(df).first().seen == "a" and two(df).first().seen == "abc" and C.Chain()(df).first().seen == ""


def test_headers_and_cookies(spark):
    rows = [("ua", "de-DE", {"User-Agent": "own", "X": "1"}, {"sid": "own"}), (None, "", {"X": "1"}, None), ("ua", None, None, {"b": "2"})]
    df = spark.createDataFrame(rows, "agent string, locale string, headers map<string,string>, cookies map<string,string>")
    cached = F.create_map(F.lit("sid"), F.lit("cached"))
    got = C.Chain(C.headers(F.col("agent"), F.col("locale")), C.cookies(cached))(df).collect()
    assert [r.headers for r in got] == [{"X": "1", "User-Agent": "ua", "Accept-Language": "de-DE,de;q=0.9"}, {"X": "1"}, {"User-Agent": "ua"}]
    assert [r.cookies for r in got] == [{"sid": "own"}, {"sid": "cached"}, {"sid": "cached", "b": "2"}]


def test_timing(spark):
    rows = [(T0, T0 + dt.timedelta(milliseconds=250), v) for v in (0.0, None, 7.0)]
    df = spark.createDataFrame(rows, "started timestamp, ended timestamp, total_ms double")
    assert [r.total_ms for r in C.timing("started", "ended")(df).collect()] == [250.0, 250.0, 7.0]


def test_last_attempts(spark):
    """The first that succeeds or is plainly blocked, else the last of the retries; a request with one attempt keeps it."""
    codes = {"ok": [500, 200, 200], "blocked": [500, 403, 200], "challenged": [403, 500, 200], "never": [500] * 6, "one": [404], "late": [500, 500, 500, 500, 200]}
    rows = [(k, i, c, "captcha" if k == "challenged" and c == 403 else "") for k, own in codes.items() for i, c in enumerate(own)]
    df = spark.createDataFrame(rows, "request string, id long, status_code int, challenge_type string")
    got = {r.request: (r.retry_count, r.status_code) for r in C.last_attempts("request", ["id"], 3)(df).collect()}
    assert got == {"ok": (1, 200), "blocked": (1, 403), "challenged": (2, 200), "never": (3, 500), "one": (0, 404), "late": (3, 500)}
    assert C.last_attempts("request", ["id"], 3)(df.limit(0)).collect() == []
