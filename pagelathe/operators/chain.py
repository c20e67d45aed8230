"""Steps over requests and their responses, put together as one chain of DataFrame.transform.

A step takes and gives a frame of requests, so a chain is one plan: its columns are pruned and its steps fused by the optimizer.
Steps that add to a request come in the order in which they are added, as do those that look at its response.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions import responses as R

Step = Callable[[DataFrame], DataFrame]
_TEXTS = "map<string,string>"


class Chain:
    """Steps in order; adding one gives a new chain, so a chain can be the beginning of several."""

    def __init__(self, *steps: Step):
        self.steps = steps

    def add(self, *steps: Step) -> Chain:
        return Chain(*self.steps, *steps)

    def __call__(self, requests: DataFrame) -> DataFrame:
        return reduce(lambda df, step: df.transform(step), self.steps, requests)

    @classmethod
    def default(cls, identity: tuple[Column, Column] | None = None, most: int = 3) -> Chain:
        """Retries and timing, and headers where an identity (user agent and locale) is given."""
        chain = cls(last_attempts("request", ["ts", "event_id"], most), timing("started", "ended"))
        return chain.add(headers(*identity)) if identity else chain


def over(below: Column, above: Column) -> Column:
    """Two maps as one, above's values before below's; null counts as empty."""
    above = F.coalesce(above, F.create_map().cast(_TEXTS))
    return F.map_concat(F.map_filter(F.coalesce(below, F.create_map().cast(_TEXTS)), lambda k, v: ~F.map_contains_key(above, k)), above)


def _known(**values: Column) -> Column:
    """A map of the values that are not null; _ in a name stands for -."""
    pairs = F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("key"), v.alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def headers(agent: Column, locale: Column, column: str = "headers") -> Step:
    """The identity's headers over the request's own: User-Agent, and Accept-Language of the locale and its language."""
    language = F.concat(locale, F.lit(","), F.substring(locale, 1, 2), F.lit(";q=0.9"))
    told = lambda c, value: F.when(c != "", value)
    return lambda df: df.withColumn(column, over(F.col(column), _known(User_Agent=told(agent, agent), Accept_Language=told(locale, language))))


def cookies(cached: Column, column: str = "cookies") -> Step:
    """Cached cookies under the request's own, which win."""
    return lambda df: df.withColumn(column, over(cached, F.col(column)))


def timing(started: str, ended: str, column: str = "total_ms") -> Step:
    """The time from start to end where none, or 0, has been recorded."""
    spent = (F.unix_micros(ended) - F.unix_micros(started)) / 1000
    return lambda df: df.withColumn(column, F.when(F.coalesce(F.col(column), F.lit(0.0)) == 0, spent).otherwise(F.col(column)))


def last_attempts(request: str, order: list[str], most: int = 3, status: str = "status_code", challenge: str = "challenge_type") -> Step:
    """Of each request's attempts the one after which there is no more: the first that succeeds or is blocked without a
    challenge, else the last of most retries; with its number as retry_count. A task keeps a few rows of a request."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(request).orderBy(*order)) - 1
    s, c = F.col(status), F.col(challenge)
    stop = R.is_success(s) | (R.is_blocked(s, c) & (c == ""))

    def step(df: DataFrame) -> DataFrame:
        tried = df.withColumn("retry_count", nth).where(F.col("retry_count") <= most)
        rank = F.when(stop, F.col("retry_count")).otherwise(most + most - F.col("retry_count") + 1)
        best = F.row_number().over(Window.partitionBy(request).orderBy(rank))
        return tried.withColumn("__best", best).where("__best = 1").drop("__best")

    return step
