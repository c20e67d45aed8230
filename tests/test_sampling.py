"""Draws against the laws that they state, at fixed seeds, and under any partitioning."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelathe.operators import sampling as S


def unlikely(observed, expected) -> bool:
    """Whether a chi-square test rejects at about 1 in 10,000 (Wilson and Hilferty's quantile)."""
    x = sum((o - e) ** 2 / e for o, e in zip(observed, expected, strict=True))
    k = len(observed) - 1
    return x > k * (1 - 2 / (9 * k) + 3.72 * math.sqrt(2 / (9 * k))) ** 3


def test_alias_table_has_the_shares():
    for shares in ({"a": 1.0}, {"a": 0.6, "b": 0.3, "c": 0.1}, {str(i): (i + 1) ** 2 for i in range(50)}, {"a": 0.0, "b": 2.0, "c": 1e-9}):
        names, own, other = S.alias_table(shares)
        got = Counter()
        for i, x in enumerate(own):
            got[names[i]] += x / len(names)
            got[names[other[i]]] += (1 - x) / len(names)
        assert all(abs(got[n] - s / sum(shares.values())) < 1e-12 for n, s in shares.items())
    for bad in ({"a": 0.0}, {"a": -1.0, "b": 2.0}):
        with pytest.raises(ValueError):
            S.alias_table(bad)


@pytest.mark.parametrize("seed", [1, 7])
def test_categories_follow_their_shares(spark, seed):
    shares = {f"c{i}": 1 / (i + 1) for i in range(12)}
    df = spark.range(60_000).select("id", S.categorical(F.col("id"), shares, seed).alias("c"))
    got = Counter(r.c for r in df.collect())
    total = sum(shares.values())
    assert not unlikely([got[c] for c in shares], [60_000 * s / total for s in shares.values()])
    assert {r.id: r.c for r in df.collect()} == {r.id: r.c for r in spark.range(60_000).repartition(7).select("id", S.categorical(F.col("id"), shares, seed).alias("c")).collect()}


@pytest.mark.parametrize("seed", [3, 11])
def test_weighted_choice_is_in_proportion(spark, seed):
    weights = [0.5, 1.0, 2.0, 4.0, 8.0]
    df = spark.range(20_000 * 5).select((F.col("id") / 5).cast("long").alias("g"), (F.col("id") % 5).alias("item"), F.element_at(F.array(*map(F.lit, weights)), (F.col("id") % 5 + 1).cast("int")).alias("w"))
    got = Counter(r.item for r in S.weighted_choice(df, "g", "item", "w", seed).collect())
    assert not unlikely([got[i] for i in range(5)], [20_000 * w / sum(weights) for w in weights])


def test_weighted_sample_without_replacement(spark):
    """The law of ordered pairs: first in proportion, second in proportion among the rest; any partitioning draws the same."""
    weights = {0: 1.0, 1: 2.0, 2: 5.0, 3: 0.0, 4: None}
    rows = [(g, i, w) for g in range(6000) for i, w in weights.items()]
    df = spark.createDataFrame(rows, "g long, item long, w double")
    got = S.weighted_sample(df, "g", "item", "w", 2, 5).collect()
    drawn = {}
    for r in got:
        drawn.setdefault(r.g, {})[r.place] = r.item
    pairs = Counter((x[1], x[2]) for x in drawn.values())
    law = {(a, b): weights[a] / 8 * weights[b] / (8 - weights[a]) for a, b in itertools.permutations((0, 1, 2), 2)}
    assert len(drawn) == 6000 and set(pairs) <= set(law) and not unlikely([pairs[k] for k in law], [6000 * p for p in law.values()])
    again = S.weighted_sample(df.repartition(9), "g", "item", "w", 2, 5).collect()
    assert set(map(tuple, got)) == set(map(tuple, again))
    assert {r.item for r in S.weighted_sample(df, "g", "item", "w", 10, 5).where("g = 1").collect()} == {0, 1, 2}
    assert S.weighted_sample(df.limit(0), "g", "item", "w", 2, 5).collect() == []


def test_beta_draws_follow_their_law(spark):
    """Nine tenths from Beta(alpha, beta), a tenth uniform: the empirical distribution against one of other draws."""
    arms = spark.range(20_000).select("id", F.lit(3.0).alias("a"), F.lit(5.0).alias("b"))
    got = np.sort([r.draw for r in S.beta_draws(arms, "id", "a", "b", 7).collect()])
    r = np.random.default_rng(0)
    other = np.sort(np.where(r.random(200_000) < 0.1, r.random(200_000), r.beta(3, 5, 200_000)))
    at = np.linspace(0.01, 0.99, 99)
    gap = np.abs(np.searchsorted(got, at) / len(got) - np.searchsorted(other, at) / len(other)).max()
    assert gap < 2.2 * math.sqrt(1 / len(got) + 1 / len(other))  # Kolmogorov's bound at about 1 in 10,000
    again = {x.id: x.draw for x in S.beta_draws(arms.repartition(5), "id", "a", "b", 7).collect()}
    assert sorted(again.values()) == got.tolist()
