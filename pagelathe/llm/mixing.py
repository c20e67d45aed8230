"""Mixing to target weights: iterative proportional fitting to source, language and topic marginals, then sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm import topics
from pagelathe.llm.packing import word_counts
from pagelathe.llm.scratch import by_ids, discard, sized, written

#: Share of all tokens to keep, in expectation.
RATE = 0.8
#: Default targets: a category's share is proportional to its tokens to this power, which lifts small categories.
FLATTEN = 0.8
#: Up to so many counted cells are raked on the driver; more of them stay distributed, with the same result.
DRIVER_CELLS = 100_000
NONE = "(none)"
SEED = 20240607


def rake(tokens: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], rate: float, rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Sampling probabilities of cells of tokens; axes has for each marginal the category of each cell.

    Each round scales the cells to every marginal's target of rate * sum(tokens) and cuts a cell at its own tokens, as a
    probability can't pass 1. Without such cuts this is classical raking and converges to the targets; with them the
    last rounds settle on the nearest shares that the cells can give.
    """
    total = float(tokens.sum())
    if not total:
        return np.zeros(len(tokens))
    want = tokens * rate
    for _ in range(rounds):
        before = want
        for axis, target in zip(axes, targets, strict=True):
            now = np.bincount(axis, want, len(target))
            want = np.minimum(want * np.divide(target * total * rate, now, out=np.zeros(len(target)), where=now > 0)[axis], tokens)
        if np.abs(want - before).max() <= tolerance * total:
            break
    return np.divide(want, tokens, out=np.zeros(len(tokens)), where=tokens > 0)


def rake_distributed(cells: DataFrame, kinds: list[str], targets: dict[str, dict[str, float]], rate: float, rounds: int = 500, tolerance: float = 1e-9) -> DataFrame:
    """rake() of a written table of cells (categories and tokens): cells with their probability. Default shares where
    targets has none. The driver sees totals only; each step joins a table of one factor a category."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goals, counts = {}, {}
    for k in kinds:
        goal = cells.groupBy(k).agg(F.pow(F.sum("tokens").cast("double"), F.lit(FLATTEN)).alias("share"))
        if targets.get(k):
            given = cells.sparkSession.createDataFrame(list(targets[k].items()), "name string, given double")
            goal = goal.join(given, goal[k] == given["name"], "left").select(k, F.coalesce("given", F.lit(0.0)).alias("share"))
        goals[k] = written(goal, "goal")
        counts[k], whole = goals[k].agg(F.count("*"), F.sum("share")).first()
        goals[k] = goals[k].select(k, (F.col("share") / (whole or 1.0) * total * rate).alias("goal"))
    state = written(cells.select(*kinds, F.col("tokens").cast("double").alias("tokens"), (F.col("tokens") * F.lit(float(rate))).alias("want")), "rake")
    for _ in range(rounds):
        moved = state.withColumn("before", F.col("want"))
        for k in kinds:
            now = moved.groupBy(k).agg(F.sum("want").alias("now")).join(sized(goals[k], counts[k]), k)
            factor = now.select(k, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("factor"))
            step = moved.join(sized(factor, counts[k]), k)
            after = written(step.select(*kinds, "tokens", F.least(F.col("want") * F.col("factor"), F.col("tokens")).alias("want"), "before"), "rake")
            discard(state)
            state = moved = after
        if (moved.agg(F.max(F.abs(F.col("want") - F.col("before")))).first()[0] or 0.0) <= tolerance * total:
            break
    return state.select(*kinds, F.when(F.col("tokens") > 0, F.col("want") / F.col("tokens")).otherwise(1.0).alias("probability"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """Per row: id, n_tokens, source_cat, lang_cat, topic_cat, probability, sampled.

    targets gives shares for categories of "source", "lang", "topic"; without them each marginal's shares follow its
    tokens to the power FLATTEN. A row is sampled when a hash of seed and id, taken as a number in [0, 1), lies below
    its cell's probability, so a rerun or a repeated row decides alike. Null categories form the category "(none)".
    Without a topic, topics are learned from all texts (pagelathe.llm.topics).
    Texts without words carry no tokens: probability 1. A null id is hashed as the seed alone. An empty table gives an
    empty result.

    Cells are summed first. They are raked on the driver while there are at most DRIVER_CELLS of them, else distributed.
    """
    given = {"source": F.col(source), "lang": F.col(lang)} | ({} if topic is None else {"topic": topic})
    kinds = ["source", "lang", "topic"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.coalesce(c.cast("string"), F.lit(NONE)).alias(k) for k, c in given.items()))
    # the counter sees (struct of id and categories, text), so that no join by id is needed
    packed = rows.select(F.struct("id", *given).alias("row"), "text")
    if topic is None:
        bags = topics.bagged(rows, F.struct("id", *given), "id", "text")
        counted = written(topics.assigned(bags, topics.fit(bags)).select("row.*", "n_tokens", "topic"), "counted")
        discard(bags)
    else:
        counted = written(word_counts(packed, "row", "text").select("row.*", "n_tokens"), "counted")
    cells = written(counted.groupBy(*kinds).agg(F.sum("n_tokens").alias("tokens")), "cells")
    folded = [F.col(k).alias(f"{k}_cat") for k in kinds]
    cats = [f"{k}_cat" for k in kinds]
    merged = cells.select(*folded, "tokens")
    n_cells = merged.count()
    if n_cells <= DRIVER_CELLS:
        table = merged.toPandas()
        tokens = table["tokens"].to_numpy(dtype=float)
        axes, shares = [], []
        for k in kinds:
            axis, names = pd.factorize(table[f"{k}_cat"], sort=True)
            own = np.bincount(axis, tokens, len(names)) if len(names) else np.zeros(0)
            given = (targets or {}).get(k)
            share = np.array([given.get(n, 0.0) for n in names]) if given else own**FLATTEN
            axes.append(axis)
            shares.append(share / share.sum() if share.sum() else share)
        table["probability"] = np.where(tokens > 0, rake(tokens, axes, shares, rate), 1.0) if len(table) else np.zeros(0)
        by_cell = docs.sparkSession.createDataFrame([tuple(r) for r in table[[*cats, "probability"]].itertuples(index=False)], "source_cat string, lang_cat string, topic_cat string, probability double")
    else:
        by_cell = rake_distributed(merged, cats, {f"{k}_cat": t for k, t in (targets or {}).items()}, rate)
    out = counted.select("id", "n_tokens", *folded).join(sized(by_cell, n_cells), cats)
    chance = F.when(F.col("n_tokens") > 0, F.col("probability")).otherwise(1.0)
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return out.select(F.col("id").alias(id_col), "n_tokens", "source_cat", "lang_cat", "topic_cat", chance.alias("probability"), (drawn < chance).alias("sampled"))


def achieved(mixed: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Of a mix(), per marginal and category: tokens, target (share; the default one where targets has none), expected (share of
    the tokens that the probabilities keep) and drawn (share of the sampled ones).

    expected differs from target only where cells were cut at their own tokens, or raking ended before it converged.
    """
    parts = []
    for k in ("source", "lang", "topic"):
        cat = F.col(f"{k}_cat")
        g = mixed.groupBy(cat.alias("category")).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("e"), F.sum(F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)).alias("d"))
        own = (targets or {}).get(k)
        goal = F.pow(F.col("tokens").cast("double"), F.lit(FLATTEN))
        if own:
            goal = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in own.items() for x in kv)), F.col("category")), F.lit(0.0))
        g = g.withColumn("g", goal)
        total = g.agg(*(F.sum(c).alias(f"all_{c}") for c in "ged"))
        share = lambda c: F.when(F.col(f"all_{c}") > 0, F.col(c) / F.col(f"all_{c}"))
        parts.append(g.join(F.broadcast(total)).select(F.lit(k).alias("marginal"), "category", "tokens", share("g").alias("target"), share("e").alias("expected"), share("d").alias("drawn")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sample_mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The sampled rows of docs, all columns; rows with a null id follow the draw of their cell."""
    found = written(mix(docs, id_col, **options), "mix")
    lost = written(found.where(~F.col("sampled") & F.col(id_col).isNotNull()).select(id_col).distinct(), "lost")
    return by_ids(docs, id_col, lost, "left_anti")


def op6_mix(spark, sf_dir: str) -> DataFrame:
    """Sampling decisions for documents at the default targets."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
