from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_langid import plain_verdict
from test_mixing import plain_mix
from pagelathe.llm import langid, mixing, packing, topics, words
from pagelathe.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_exact(rows):
    best = {}
    for r in rows:
        k = (r.text or "").translate(UP)
        best[k] = min(best.get(k, r.doc_id), r.doc_id)
    return {r.doc_id for r in rows if best[(r.text or "").translate(UP)] == r.doc_id}


def brute_near(rows):
    sets = {r.doc_id: shingles(r.text) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def plain_topic(text, model):
    x = np.zeros(topics.HASHED)
    data = (text or "").encode()
    for h in words.word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist():
        x[h % topics.HASHED] += 1
    scores = [float((np.log1p(x) * model.idf) @ c) for c in model.centers]
    return f"topic-{int(np.argmax(scores)):02d}" if x.any() else topics.NO_TOPIC


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "s", 0), (90003, "123", "en", "s", 3), (0, None, None, None, None)], real.schema)
    return real.unionByName(odd).withColumn("norm", F.lit("clash")).withColumn("key", F.lit("clash"))


def test_stages_against_brute_force(spark, docs):
    learned = langid.learn(docs)
    verdicts = [(r.doc_id, plain_verdict(r.text, learned)) for r in docs.collect()]
    expected = {i for i, (lang, least, margin) in verdicts if lang != "und" and margin >= max(1, 0.03 * least)}
    one = cp.language_id(spark, docs, SF)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == expected
    two = cp.exact_dedup(spark, one, SF)
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == brute_exact(one.collect()) and two.count() == len({r.doc_id for r in two.collect()})
    three = cp.near_dedup(spark, two, SF)
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == brute_near(two.collect())
    four = cp.mix_sources(spark, three, SF)
    # words counted, raked and drawn in plain Python; the topic of a text by a loop over its words
    model, kept = topics.learn(three), three.collect()
    rows = [(r.doc_id, len((r.text or "").encode().split()), (r.source or mixing.NONE, r.lang or mixing.NONE, plain_topic(r.text, model))) for r in kept]
    hashes = {r[0]: r[1] for r in three.select("doc_id", F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id"), F.lit(1 << 40)) / float(1 << 40)).collect()}
    drawn = {row[0] for row, p in zip(rows, plain_mix(rows, mixing.RATE), strict=True) if hashes[row[0]] < p}
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == drawn and 0.5 * three.count() < len(drawn) < three.count()
    five = cp.pack_batches(spark, four, SF).collect()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in four.collect()}
    packed = {}
    for r in five:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
    assert packed == words and max(r.n_tokens for r in five) <= packing.MAX_TOKENS


def test_run_and_names(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack_batches"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_hand = docs
    for _, stage in cp.STAGES:
        by_hand = stage(spark, by_hand, SF)
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, by_hand.collect()))
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 14)) and set(oracle_sql()) == {"op3_exact_dup", "op7_warc", "op11_spelling", "op13_divergence"}


@pytest.mark.parametrize("k", range(5))
def test_empty_input(spark, docs, k):
    assert cp.STAGES[k][1](spark, docs.limit(0), SF).collect() == []


def test_mix_learns_from_every_text(spark, docs, monkeypatch):
    """The stage's topics are fitted on a bag for each of its rows."""
    seen, plain = [], topics.fit
    monkeypatch.setattr(topics, "fit", lambda bags, *more: seen.append(bags.count()) or plain(bags, *more))
    cp.mix_sources(spark, docs, SF)
    assert seen == [docs.count()]
