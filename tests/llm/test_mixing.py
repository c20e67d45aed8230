from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelathe.llm import mixing as mx
from pagelathe.llm import topics as tp
from pagelathe.llm import words as wd


def test_raking_meets_feasible_targets():
    r = np.random.default_rng(0)
    tokens = r.uniform(50, 150, 24)
    axes = [np.arange(24) % 4, np.arange(24) // 4 % 3, np.arange(24) // 12]
    targets = [np.array([0.3, 0.25, 0.25, 0.2]), np.array([0.4, 0.3, 0.3]), np.array([0.55, 0.45])]
    p = mx.rake(tokens, axes, targets, 0.4)
    assert ((p >= 0) & (p <= 1)).all()
    for axis, target in zip(axes, targets, strict=True):
        np.testing.assert_allclose(np.bincount(axis, p * tokens) / (p * tokens).sum(), target, atol=1e-6)
    assert abs((p * tokens).sum() / tokens.sum() - 0.4) < 1e-6


def test_infeasible_cells_are_cut_at_one():
    p = mx.rake(np.array([10.0, 990.0]), [np.array([0, 1])], [np.array([0.5, 0.5])], 0.5)
    assert p[0] == 1.0 and 0 < p[1] <= 1


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(0)
    rows = [(i, " ".join(["w"] * r.randrange(1, 60)) + r.choice(["", "\n", " | "]), r.choice(["a", "a", "a", "b", None]), r.choice(["en", "fr"]), "clash") for i in range(3000)]
    rows += [(5000, None, "a", "en", "c"), (5001, "", None, None, "c"), (None, "w w", "a", "en", "c"), (3, rows[3][1], rows[3][2], rows[3][3], "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, probability string")


def test_sampling_follows_the_probabilities(spark, docs):
    got = mx.mix(docs, rate=0.5).collect()
    assert len(got) == docs.count()
    cells = defaultdict(list)
    for g in got:
        cells[(g.source_cat, g.lang_cat, g.topic_cat)].append(g)
    for own in cells.values():
        with_tokens = [g for g in own if g.n_tokens]
        assert len({g.probability for g in with_tokens}) <= 1
        if len(with_tokens) > 100:
            assert abs(np.mean([g.sampled for g in with_tokens]) - with_tokens[0].probability) < 0.15
    # brute force of the same raking and draws
    tokens = np.array([sum(g.n_tokens for g in own) for own in cells.values()], dtype=float)
    axes, shares = [], []
    for k in range(3):
        names, axis = np.unique([c[k] for c in cells], return_inverse=True)
        own = np.bincount(axis, tokens)
        axes.append(axis)
        shares.append(own**mx.FLATTEN / (own**mx.FLATTEN).sum())
    for (cell, own), p in zip(cells.items(), mx.rake(tokens, axes, shares, 0.5), strict=True):
        assert all(abs(g.probability - p) < 1e-9 for g in own if g.n_tokens), cell
    drawn = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(mx.SEED), "doc_id"), F.lit(1 << 40)) / float(1 << 40)).collect()}
    assert all(g.sampled == (drawn[g.doc_id] < g.probability) for g in got)
    assert all(g.sampled for g in got if not g.n_tokens)


def test_given_targets(spark, docs):
    got = mx.mix(docs, targets={"lang": {"en": 0.2, "fr": 0.8}}, rate=0.3).collect()
    assert {g.source_cat for g in got} == {"a", "b", mx.NONE}
    kept = defaultdict(float)
    for g in got:
        kept[g.lang_cat] += g.n_tokens * g.probability
    assert abs(kept["fr"] / sum(kept.values()) - 0.8) < 1e-3


def test_sample_keeps_columns(spark, docs):
    kept = mx.sample_mix(docs, rate=0.5)
    assert kept.columns == docs.columns
    chosen = {g.doc_id for g in mx.mix(docs, rate=0.5).collect() if g.sampled}
    assert {r.doc_id for r in kept.collect()} - {None} == chosen - {None}
    assert mx.mix(docs.limit(0)).collect() == [] and mx.sample_mix(docs.limit(0)).collect() == []


def test_every_source_has_its_own_target(spark):
    """A thousand equal sources, most of them beyond any fixed number of names, get a thousandth each."""
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("w w w w w").alias("text"), F.concat(F.lit("s"), F.col("id") % 1000).alias("source"), F.lit("en").alias("lang"))
    kept = defaultdict(float)
    for g in mx.mix(df, rate=0.5).collect():
        kept[g.source_cat] += g.n_tokens * g.probability
    assert len(kept) == 1000
    np.testing.assert_allclose([k / sum(kept.values()) for k in kept.values()], 0.001, atol=1e-9)


@pytest.mark.parametrize("targets", [None, {"lang": {"en": 0.2, "fr": 0.8}}])
def test_distributed_cells_give_the_same(spark, docs, monkeypatch, targets):
    one = {(g.doc_id, g.n_tokens, g.source_cat, g.lang_cat, g.topic_cat): g for g in mx.mix(docs, targets=targets, rate=0.5).collect()}
    monkeypatch.setattr(mx, "DRIVER_CELLS", 0)
    got = mx.mix(docs, targets=targets, rate=0.5).collect()
    assert len(got) == docs.count()
    for g in got:
        other = one[(g.doc_id, g.n_tokens, g.source_cat, g.lang_cat, g.topic_cat)]
        assert abs(g.probability - other.probability) < 1e-9 and g.sampled == other.sampled


def plain_rake(cells, shares, rate, rounds=500):
    """Raking with dictionaries only: cells has tokens by (source, lang, topic), shares a target for each category."""
    total = sum(cells.values())
    want = {c: t * rate for c, t in cells.items()}
    for _ in range(rounds):
        before = dict(want)
        for k in range(3):
            now = defaultdict(float)
            for c, w in want.items():
                now[c[k]] += w
            want = {c: min(w * shares[k][c[k]] * total * rate / now[c[k]] if now[c[k]] else 0.0, cells[c]) for c, w in want.items()}
        if max(abs(want[c] - before[c]) for c in want) <= 1e-9 * total:
            break
    return {c: w / cells[c] for c, w in want.items()}


def plain_mix(rows, rate):
    """Probabilities of (id, words, (source, lang, topic)) rows, in order."""
    cells, sums = defaultdict(float), [defaultdict(float) for _ in range(3)]
    for _, n, c in rows:
        cells[c] += n
        for k in range(3):
            sums[k][c[k]] += n
    shares = [{x: t**mx.FLATTEN / sum(u**mx.FLATTEN for u in own.values()) for x, t in own.items()} for own in sums]
    chance = plain_rake({c: t for c, t in cells.items() if t}, shares, rate)
    return [chance[c] if n else 1.0 for _, n, c in rows]


def test_equals_plain_python(spark, docs):
    """Words, raking and draws in plain Python, from the rows; topics by their own test."""
    topic = F.when(F.contains(F.coalesce("text", F.lit("")), F.lit("|")), "t").otherwise("p")
    got = mx.mix(docs, rate=0.6, topic=topic).collect()
    rows = [(r.doc_id, len((r.text or "").split()), (r.source or mx.NONE, r.lang or mx.NONE, "t" if "|" in (r.text or "") else "p")) for r in docs.collect()]
    want = sorted(((*row, round(p, 7)) for row, p in zip(rows, plain_mix(rows, 0.6), strict=True)), key=str)
    assert sorted(((g.doc_id, g.n_tokens, (g.source_cat, g.lang_cat, g.topic_cat), round(g.probability, 7)) for g in got), key=str) == want


def test_achieved_shares(spark, docs):
    targets = {"lang": {"en": 0.3, "fr": 0.7}}
    got = {(r.marginal, r.category): r for r in mx.achieved(mx.mix(docs, targets=targets, rate=0.3), targets).collect()}
    assert abs(got["lang", "fr"].target - 0.7) < 1e-12 and abs(got["lang", "fr"].expected - 0.7) < 1e-6 and abs(got["lang", "fr"].drawn - 0.7) < 0.1
    for k in ("source", "lang", "topic"):
        assert abs(sum(r.expected for (m, _), r in got.items() if m == k) - 1) < 1e-9
    scarce = {(r.marginal, r.category): r for r in mx.achieved(mx.mix(docs, targets={"source": {"b": 0.9, "a": 0.1}}, rate=0.8), {"source": {"b": 0.9, "a": 0.1}}).collect()}
    assert scarce["source", "b"].expected < 0.9 == scarce["source", "b"].target


def test_topics_tell_vocabularies_apart(spark):
    """Texts of three vocabularies, some rows odd: each vocabulary gets topics of its own, against a plain loop."""
    r = random.Random(2)
    texts = [(i, " ".join(f"{'abc'[i % 3]}{r.randrange(300)}" for _ in range(40)), i % 3) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(9001, None), (9002, ""), (None, "a1 a2 a3"), (9003, "a5 " * 60000)], "doc_id long, text string")
    model = tp.learn(df, topics=6)
    got = {x.doc_id: (x.n_tokens, x.topic) for x in tp.word_counts_and_topics(df, model).collect()}
    assert got[9001] == got[9002] == (0, tp.NO_TOPIC) and got[9003][0] == 60000
    kinds = defaultdict(set)
    for i, t, v in texts:
        kinds[got[i][1]].add(v)
        x = np.zeros(tp.HASHED)
        for h in wd.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0].tolist():
            x[h % tp.HASHED] += 1
        x = np.log(1 + x) * model.idf
        near = [float(x @ c) for c in model.centers]
        assert near[int(got[i][1][6:])] > max(near) - 1e-4
    assert all(len(v) == 1 for v in kinds.values()) and len(kinds) >= 3
    assert tp.learn(df.limit(0)) is None and tp.topics_of(pa.array(["x", None]), None)[1] == [tp.NO_TOPIC] * 2


def test_topics_are_fitted_on_all_texts(spark):
    """Words count in every text, also in one of more than 20,000 characters and in more than 2,000 texts, and the model does not
    depend on how rows are dealt out."""
    r = random.Random(4)
    rows = [(i, " ".join(f"{'abc'[i % 3]}{r.randrange(99)}" for _ in range(8))) for i in range(2600)] + [(9001, "long " * 9000), (9002, None), (9003, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = tp.learn(df.repartition(5), topics=6)
    df_of = np.zeros(tp.HASHED)
    for _, t in rows:
        data = (t or "").encode()
        df_of[np.unique(wd.word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0] % np.uint64(tp.HASHED)).astype(int)] += 1
    np.testing.assert_allclose(model.idf, np.log(2602 / (1 + df_of)) + 0.1, rtol=1e-5)
    again = tp.learn(df.orderBy(F.desc("doc_id")).coalesce(1), topics=6)
    assert np.array_equal(model.idf, again.idf) and np.array_equal(model.centers, again.centers)
