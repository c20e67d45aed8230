"""Alerts over scraped metrics: range vectors at one-minute steps, rules, and the time that a rule must hold.

Samples are (label, ts, value) rows, counters have a series, too. A sample counts at the steps of the window that begins with it,
so steps without a sample in their window have no value, and nothing is made for quiet times. Samples are summed by minute
before they are put to their steps, and a counter's differences are a split scan, so one series may hold most of the rows.
Rows with a null time or value are left out; a null label is a label of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.operators.aggregates import held
from pagelathe.operators.scans import scan

# Rule name, comparison, threshold, minutes it must hold; the range of rates and of the last value in seconds.
RULES = [("HighBanScore", ">", 0.5, 2), ("DomainBlocked", ">", 0.8, 1), ("ProxyPoolLow", "<", 5, 5), ("HighFailureRate", ">", 0.3, 3), ("KafkaQueueBacklog", ">", 5000, 5), ("NoWorkers", "==", 0, 1)]
RANGE_SECONDS, STEP_SECONDS = 300, 60


def _minutes(samples: DataFrame, step: int) -> DataFrame:
    """samples with a value, their time in microseconds and the first step that is not before it."""
    t = samples.where(F.col("ts").isNotNull() & F.col("value").isNotNull()).withColumn("__t", F.unix_micros("ts"))
    return t.withColumn("__m", F.expr(f"(__t + {step * 10**6 - 1}) div {step * 10**6}"))


def _steps(seconds: int, step: int) -> Column:
    """The steps whose window of so many seconds holds a sample of a minute."""
    return F.explode(F.sequence(F.col("__m"), F.col("__m") + seconds // step - 1)).alias("step")


def last_value(samples: DataFrame, seconds: int = RANGE_SECONDS, step: int = STEP_SECONDS) -> DataFrame:
    """(label, step, value): the last sample of a gauge in the seconds up to each step, of those at one time the largest."""
    latest = F.max_by("value", F.struct("__t", "value")).alias("value")
    by_minute = _minutes(samples, step).groupBy("label", "__m").agg(latest, F.max("__t").alias("__t"))
    return by_minute.select("label", _steps(seconds, step), "value", "__t").groupBy("label", "step").agg(F.max_by("value", "__t").alias("value"))


def rate(samples: DataFrame, seconds: int = RANGE_SECONDS, step: int = STEP_SECONDS) -> DataFrame:
    """(series, label, step, value): the increase a second of a counter in the seconds up to each step.

    A value less than the one before is a restart from 0. A window needs two samples at different times; the increase between its
    first and last is carried on to the window's ends, but by half a mean gap where the end is further off than 1.1 of them,
    and not to before the counter's zero.
    """
    clean = _minutes(samples, step)
    seen = scan(clean, "series", "ts", ["value"], before=F.col("value"))
    more = F.when(F.col("before").isNull(), 0.0).when(F.col("value") >= F.col("before"), F.col("value") - F.col("before")).otherwise(F.col("value"))
    first = F.min_by(F.struct(F.col("value").alias("v"), F.col("__d").alias("d")), F.struct("__t", "value"))
    by_minute = seen.withColumn("__d", more.cast("double")).groupBy("series", "label", "__m").agg(F.count("*").alias("n"), F.sum("__d").alias("d"), first.alias("first"), F.min("__t").alias("begin"), F.max("__t").alias("end"))
    spread = by_minute.select("series", "label", _steps(seconds, step), "n", "d", "first", "begin", "end")
    w = spread.groupBy("series", "label", "step").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.min_by("first", "begin").alias("first"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    w = w.where((F.col("n") > 1) & (F.col("end") > F.col("begin")))
    w = w.select("series", "label", "step", "n", F.col("first.v").alias("v"), (F.col("d") - F.col("first.d")).alias("up"), ((F.col("end") - F.col("begin")) / 1e6).alias("span"), (F.col("begin") / 1e6 - (F.col("step") * step - seconds)).alias("lead"), (F.col("step") * step - F.col("end") / 1e6).alias("tail"))
    gap = F.col("span") / (F.col("n") - 1)
    near = lambda c: F.when(F.col(c) >= gap * 1.1, gap / 2).otherwise(F.col(c))
    zero = F.when(F.col("up") > 0, F.col("span") * F.col("v") / F.col("up"))
    whole = F.col("span") + F.least(near("lead"), zero) + near("tail")
    return w.select("series", "label", "step", (F.col("up") * (whole / F.col("span")) / seconds).alias("value"))


def _broken(rule: str) -> tuple[str, int, Column]:
    _, op, limit, minutes = next(r for r in RULES if r[0] == rule)
    v = F.col("value")
    return op, minutes, {">": v > limit, "<": v < limit, "==": v == limit}[op]


def threshold_alerts(series: DataFrame, rule: str, by: str = "domain") -> DataFrame:
    """Runs of minute buckets of series(by, bucket, value) in which a rule of RULES holds, of at least its minutes."""
    _, minutes, broken = _broken(rule)
    return held(series.where(broken), "bucket", minutes, by).withColumn("alert", F.lit(rule))


def firing(values: DataFrame, rule: str, step: int = STEP_SECONDS) -> DataFrame:
    """(rule, label, since, fires, until, peak): spans of steps on end at which a rule of RULES holds, that have lasted its
    minutes; fires is the step from which on they have, peak the value furthest beyond the threshold."""
    op, minutes, broken = _broken(rule)
    at = Window.partitionBy("label").orderBy("step")
    runs = values.where(broken).withColumn("island", F.col("step") - F.row_number().over(at))
    peak = (F.min if op == "<" else F.max)("value")
    spans = runs.groupBy("label", "island").agg(F.min("step").alias("since"), F.max("step").alias("until"), peak.cast("double").alias("peak"))
    hold = -(-minutes * 60 // step)
    return spans.where(F.col("until") - F.col("since") >= hold).select(F.lit(rule).alias("rule"), "label", "since", (F.col("since") + hold).alias("fires"), "until", "peak")


def failure_ratio(rates: DataFrame, failed: str) -> DataFrame:
    """(label, step, value): the rate of one series in that of all of a label; none where nothing has happened."""
    sums = rates.groupBy("label", "step").agg(F.sum(F.when(F.col("series") == failed, F.col("value"))).alias("bad"), F.sum("value").alias("all"))
    return sums.where(F.col("bad").isNotNull() & (F.col("all") > 0)).select("label", "step", (F.col("bad") / F.col("all")).alias("value"))
