"""Health, latency, reward and queue aggregations over fetch logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import responses as R

# Upper bounds of histogram buckets.
TASK_SECONDS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]
REQUEST_SECONDS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
FIELD_COUNTS = [0, 1, 2, 3, 5, 8, 12, 20]
LAST_LATENCIES = 100


def outcome(status: Column, challenge: Column) -> Column:
    """One of success, captcha, blocked, failed; the first that holds."""
    blocked = R.is_blocked(status, challenge)
    return F.when(R.is_success(status) & ~blocked, "success").when(challenge != "", "captcha").when(blocked, "blocked").otherwise("failed")


def health(log: DataFrame, *by: str) -> DataFrame:
    """Totals and rates of the outcomes of each group."""
    rows = log.withColumn("outcome", outcome(F.col("status_code"), F.col("challenge_type")))
    rate = lambda o: (F.count_if(F.col("outcome") == o) / F.greatest(F.count("*"), F.lit(1))).alias(f"{o}_rate")
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *map(rate, ("success", "blocked", "captcha", "failed")))


def last_n(df: DataFrame, n: int, by: str, *order: Column) -> DataFrame:
    """The first n rows of each group in an order; tasks keep n rows of a group before the shuffle."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= n)


def seen_by_day(df: DataFrame, ts: str, value: str, bits: int = 14) -> DataFrame:
    """(day, exact, sketch): distinct values of each day, counted and as a HyperLogLog sketch of 2 ** bits registers.

    Sketches are merged without the values (seen_in), so days need not be read again; at 14 bits an estimate is off by about
    0.6 %. Null values don't count; rows with a null time are a day of their own, null. Days shuffle one row a distinct value.
    """
    values = df.groupBy(F.to_date(ts).alias("day"), F.col(value).alias("v")).agg(F.lit(1).alias("one"))
    return values.groupBy("day").agg(F.count("v").alias("exact"), F.hll_sketch_agg("v", bits).alias("sketch"))


def seen_in(days: DataFrame, since: str, until: str) -> DataFrame:
    """(estimate): distinct values from one day up to another, both included, from the sketches of seen_by_day()."""
    own = days.where(F.col("day").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    return own.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("estimate"))


def nearest_rank(sorted_values: Column, p: float) -> Column:
    """The value at 0-based place min(int(n * p), n - 1); 0 without values."""
    n = F.size(sorted_values)
    at = F.least(F.floor(n * F.lit(p)) + 1, n).cast("int")
    return F.when(n > 0, F.element_at(sorted_values, F.greatest(at, F.lit(1)))).otherwise(0.0)


def latency(log: DataFrame, by: str = "domain", n: int = LAST_LATENCIES) -> DataFrame:
    """Median, 99th percentile and mean of each group's last n positive latencies. A group's list has n values at most."""
    recent = last_n(log.where("latency_ms > 0"), n, by, F.desc("ts"), F.desc("event_id"))
    lists = recent.groupBy(by).agg(F.array_sort(F.collect_list("latency_ms")).alias("v"), F.avg("latency_ms").alias("mean"))
    return lists.select(by, nearest_rank(F.col("v"), 0.5).alias("p50"), nearest_rank(F.col("v"), 0.99).alias("p99"), "mean")


def histogram(df: DataFrame, value: Column, bounds: list[float], *by: str) -> DataFrame:
    """Cumulative counts for each upper bound: le, n. The counts of a row's group are one aggregation, unpivoted after."""
    counted = df.groupBy(*by).agg(*(F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))
    return counted.select(*by, F.inline(rows))


def histogram_quantile(counts: DataFrame, q: float, by: str) -> DataFrame:
    """Linear interpolation inside the bucket that holds the rank q * total; the last bound if the rank lies beyond."""
    w = Window.partitionBy(by).orderBy("le")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = counts.select(by, "le", "n", F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("lo"), F.coalesce(F.lag("n").over(w), F.lit(0)).alias("below"), (F.max("n").over(whole) * q).alias("rank"), F.max("le").over(whole).alias("top"))
    inside = F.when((F.col("n") >= F.col("rank")) & (F.col("below") < F.col("rank")), F.col("lo") + (F.col("le") - F.col("lo")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below")))
    return rows.groupBy(by).agg(F.coalesce(F.min(inside), F.first("top")).alias("quantile"))


def arms(log: DataFrame, reward: Column, banned: Column, by: str) -> DataFrame:
    """Bandit arms: a reward above 0.5 is a success and adds to alpha, else 1 - reward adds to beta; a ban counts as one
    more trial without reward. The sums commute, so no ordered fold is needed."""
    r = log.select(by, reward.alias("r"), banned.cast("int").alias("ban"))
    won = F.col("r") > 0.5
    return (
        r.groupBy(by)
        .agg(
            (F.count("*") + F.sum("ban")).alias("trials"),
            F.count_if(won).alias("successes"),
            (F.count_if(~won) + F.sum("ban")).alias("failures"),
            F.sum("ban").alias("ban_hits"),
            (1.0 + F.sum(F.when(won, F.col("r")).otherwise(0.0))).alias("alpha"),
            (1.0 + F.sum(F.when(won, 0.0).otherwise(1.0 - F.col("r"))) + F.sum("ban")).alias("beta"),
        )
        .withColumn("estimate", F.col("alpha") / (F.col("alpha") + F.col("beta")))
        .withColumn("ban_rate", F.col("ban_hits") / F.greatest(F.col("trials"), F.lit(1)))
    )


def domain_reward(log: DataFrame, reward: Column, success_rate: float = 1.0, by: str = "domain") -> DataFrame:
    """Mean reward less a penalty for its spread, blended with the extraction success rate."""
    g = log.groupBy(by).agg(F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("spread"), F.count("*").alias("n"))
    less = F.when(F.col("n") > 1, F.least(F.lit(0.2), F.col("spread") * 0.5)).otherwise(0.0)
    return g.select(by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("mean") - less) * 0.7 + success_rate * 0.3)).alias("reward"))


def held(flags: DataFrame, bucket: str, minutes: int, by: str) -> DataFrame:
    """Runs of consecutive one-minute buckets (a column of minute numbers) that last at least so many minutes: start, length."""
    w = Window.partitionBy(by).orderBy(bucket)
    runs = flags.withColumn("island", F.col(bucket) - F.row_number().over(w)).groupBy(by, "island").agg(F.min(bucket).alias("start"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= minutes).drop("island")
