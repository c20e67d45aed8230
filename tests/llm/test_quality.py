from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagelathe.llm import quality as ql
from pagelathe.llm.langid import fold
from pagelathe.llm.words import word_hashes

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in ql.op8_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i], y) for i, y in labels.items() if i in got and got[i].held_out]
    assert sum(r.predicted == y for r, y in held) >= 0.93 * len(held)


def test_gradients():
    r = np.random.default_rng(0)
    model = ql.Model(6, seed=1)
    x, first, y = r.normal(size=(9, 6)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(np.where(y == 1, np.log(s := model.forward(x, first)["s"]), np.log(1 - s)))
    g = model.gradients(model.forward(x, first), first, y)
    for k, v in model.p.items():
        for i in [tuple(r.integers(0, n) for n in v.shape) for _ in range(4)]:
            old, e = v[i], 1e-6
            v[i] = old + e
            up = loss()
            v[i] = old - e
            down = loss()
            v[i] = old
            assert abs((up - down) / (2 * e) - g[k][i]) < 1e-5, k


def test_attention_weighs_passages():
    model = ql.Model(6, seed=1)
    f = model.forward(np.random.default_rng(0).normal(size=(5, 6)), np.array([0, 1, 5]))
    np.testing.assert_allclose(np.add.reduceat(f["a"], [0, 1]), [1, 1])


def test_passages_do_not_depend_on_the_block(monkeypatch):
    import pagelathe.llm.words as words

    texts = pa.array([" a b c", None, "", "x " * 200, "ÄÖ!! | 12\n", "q"])
    whole = np.concatenate([x for x, _ in ql.passages(texts)])
    assert len(whole) == 1 + 1 + 1 + 4 + 1 + 1 and np.isfinite(whole).all()
    monkeypatch.setattr(words, "BLOCK_BYTES", 3)
    words._powers.cache_clear()
    np.testing.assert_allclose(np.concatenate([x for x, _ in ql.passages(texts)]), whole, atol=1e-6)
    words._powers.cache_clear()


def test_odd_rows_and_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("c").alias("score"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "w"), (3, "word " * 50000), (3, "w")], "doc_id long, text string")
    model = ql.learn(docs.where(fold() != 2), labels)
    got = ql.scores(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert ql.scores(odd.limit(0), model).collect() == []
    for few, share in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 0.999)):
        got = {round(r.score, 6) for r in ql.scores(odd, ql.learn(docs, few)).collect()}
        assert got == {share}


def plain_score(text, model):
    """Passages, features, attention and score with loops only."""
    raw = (text or "").encode()
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\t-\r]+", raw)]
    groups = [words[i : i + ql.PASSAGE] for i in range(0, len(words), ql.PASSAGE)] or [[]]
    hashes = {w: int(h) for w, h in zip((w for _, _, w in words), (hash_of(w) for _, _, w in words), strict=True)}
    seen, hidden, energy = set(), [], []
    classes = {b: k for k, own in enumerate(ql._CLASSES) for b in own}
    for i, own in enumerate(groups):
        begin = 0 if i == 0 else own[0][0]
        end = groups[i + 1][0][0] if i + 1 < len(groups) else len(raw)
        part = raw[begin:end]
        x = [0.0] * ql.FEATURES
        for b in part:
            x[len(ql._CLASSES) + 1 if b >= 128 else classes.get(b, len(ql._CLASSES))] += 1 / max(len(part), 1)
        sizes, some, at = [e - s for s, e, _ in own], max(len(own), 1), ql._KINDS
        mean = sum(sizes) / some
        distinct = {hashes[w] for _, _, w in own}
        x[at : at + 7] = [mean / 10, math.sqrt(max(0.0, sum(n * n for n in sizes) / some - mean * mean)) / 10, sum(n <= 3 for n in sizes) / some, math.log1p(len(own)) / 5, len(distinct) / some, len(distinct - seen) / some, math.log1p(len(groups)) / 5]
        seen |= distinct
        for _, _, w in own:
            h = hashes[w]
            x[at + 7 + h % ql.HASHED] += (1 if h >> 40 & 1 else -1) / math.sqrt(some)
        z = [(v - c) / s for v, c, s in zip(x, model.center, model.scale, strict=True)]
        p = model.p
        h = [math.tanh(sum(z[k] * p["W"][k][j] for k in range(len(z))) + p["b"][j]) for j in range(ql.HIDDEN)]
        gate = [math.tanh(sum(h[k] * p["V"][k][j] for k in range(ql.HIDDEN))) / (1 + math.exp(-sum(h[k] * p["U"][k][j] for k in range(ql.HIDDEN)))) for j in range(ql.GATES)]
        hidden.append(h)
        energy.append(sum(g * w for g, w in zip(gate, p["w"], strict=True)))
    a = [math.exp(e - max(energy)) for e in energy]
    z = [sum(w * h[j] for w, h in zip(a, hidden, strict=True)) / sum(a) for j in range(ql.HIDDEN)]
    return 1 / (1 + math.exp(-sum(v * c for v, c in zip(z, model.p["c"], strict=True)) - model.p["d"][0]))


def hash_of(word):
    return word_hashes(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0]


def test_equals_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = ql.learn(docs.where(fold() != 2), spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + [None, "", " \n", "One", "Ä | 12\n" * 70, "  lead a b"]
    got = model.score(pa.array(texts))
    np.testing.assert_allclose(got, [plain_score(t, model) for t in texts], atol=2e-4)


def test_conflicting_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, 7), (3, None)], "doc_id long, quality int")
    assert abs(ql.learn(docs, labels).p["d"][0] - np.log(0.999 / 0.001)) < 1e-9
