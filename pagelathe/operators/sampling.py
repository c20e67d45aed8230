"""Seeded draws: Beta samples, weighted choice, categories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *key: Column | str) -> Column:
    """A number in (0, 1) from a hash, the same in every run."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def beta_draws(arms: DataFrame, arm: str, alpha: str, beta: str, seed: int, explore: float = 0.1) -> DataFrame:
    """Per arm: a draw from Beta(alpha, beta), or with probability explore a uniform one. The largest draw wins."""

    @F.pandas_udf("double")
    def draw(a: pd.Series, b: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(int(k)).beta(x, y) for x, y, k in zip(a, b, s, strict=True)], dtype=float)

    key = F.pmod(F.xxhash64(F.lit(seed), arm), F.lit(1 << 53))
    drawn = F.when(uniform(seed + 1, arm) < explore, uniform(seed + 2, arm)).otherwise(draw(alpha, beta, key))
    return arms.select(arm, drawn.alias("draw"))


def weighted_choice(df: DataFrame, group: str, item: str, weight: str, seed: int) -> DataFrame:
    """One item of each group with probability in proportion to its weight: the largest u ** (1 / weight) wins."""
    return weighted_sample(df, group, item, weight, 1, seed).select(group, item)


def weighted_sample(df: DataFrame, group: str, item: str, weight: str, n: int, seed: int) -> DataFrame:
    """(group, item, place): n items of each group without replacement, each next one with probability in proportion to its
    weight among those left; all items of a smaller group.

    An item's key is log(u) / weight, with u from a hash of seed, group and item, and the n largest keys are the sample: tasks
    keep n rows of a group before the shuffle, and the draws are the same under any partitioning. Items without a positive
    weight are never drawn; rows repeated with group and item have equal keys and are taken apart by nothing, so items should
    be distinct.
    """
    rows = df.where(F.col(weight) > 0).select(group, item, (F.log(uniform(seed, group, item)) / F.col(weight)).alias("__key"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("__key"), item))
    return rows.withColumn("place", place).where(F.col("place") <= n).select(group, item, "place")


def alias_table(shares: dict[str, float]) -> tuple[list[str], list[float], list[int]]:
    """Names, and for each of as many equal cells the part that is its own name's and the name that has the rest."""
    names, total = list(shares), sum(shares.values())
    if not total > 0 or min(shares.values()) < 0:
        raise ValueError("shares must not be negative, nor all 0")
    own, other = [s / total * len(names) for s in shares.values()], list(range(len(names)))
    small, large = [i for i, x in enumerate(own) if x < 1], [i for i, x in enumerate(own) if x >= 1]
    while small and large:
        i, j = small.pop(), large[-1]
        other[i] = j
        own[j] -= 1 - own[i]
        if own[j] < 1:
            small.append(large.pop())
    for i in small + large:  # what rounding has left
        own[i] = 1.0
    return names, own, other


def categorical(key: Column, shares: dict[str, float], seed: int) -> Column:
    """A category by its share, from a hash of key: one lookup in an alias table, however many categories there are."""
    names, own, other = alias_table(shares)
    u = uniform(seed, key) * len(names)
    cell = F.least(F.floor(u), F.lit(len(names) - 1)).cast("int")
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), cell + 1)
    return F.element_at(F.array(*map(F.lit, names)), F.when(u - cell < at(own), cell).otherwise(at(other)) + 1)
