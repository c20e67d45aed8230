"""Quality by attention-based multiple-instance learning: passages are encoded, gated attention weighs them, and the
weighted passage representation is scored. Only document labels are learned from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.langid import fold
from pagelathe.llm.words import blocks, spans, word_hashes

#: Words of a passage; the last passage of a text may have fewer. A text always has one passage at least.
PASSAGE = 64
#: Labelled texts that the model is fitted on at most: those with the smallest hashes of their ids, of FIT_CHARS at most.
FIT_TEXTS, FIT_CHARS = 3000, 50_000
#: Signed buckets of hashed words. More of them did worse on held-out labels (sf0.1: AUC 0.997 with 48, 0.994 with 1,024).
HASHED, HIDDEN, GATES = 48, 24, 12
EPOCHS, RATE, DECAY, FIT_BATCH = 40, 0.01, 1e-4, 32
THRESHOLD = 0.7
SEED = 5

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#", b"$%&", b"*", b"@/:\\_", b"\"'()[]{}<>=+-;"]
_KIND = np.full(256, len(_CLASSES), dtype=np.int64)  # control characters and the rest
for _i, _own in enumerate(_CLASSES):
    _KIND[list(_own)] = _i
_KIND[128:] = len(_CLASSES) + 1  # bytes of characters beyond ASCII
_KINDS = len(_CLASSES) + 2
FEATURES = _KINDS + 7 + HASHED


def passages(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of all passages of a block of texts, index of each text's first passage and one more at the end)."""
    for _, data, offsets in blocks(texts):
        starts, ends, index = spans(data, offsets)
        hashes, _ = word_hashes(data, offsets)
        n_words = np.diff(index)
        n_passages = np.maximum(1, -(-n_words // PASSAGE))
        first = np.concatenate(([0], np.cumsum(n_passages)))
        total = int(first[-1])
        x = np.zeros((total, FEATURES), dtype=np.float32)
        text_of = np.repeat(np.arange(len(n_words)), n_words)
        p_of = first[text_of] + (np.arange(len(starts)) - index[text_of]) // PASSAGE
        # a passage's bytes reach from its first word to the next passage's; a text's first takes what stands before
        heads = np.flatnonzero(np.concatenate(([True], p_of[1:] != p_of[:-1]))) if len(p_of) else np.zeros(0, np.int64)
        begin = np.zeros(total, dtype=np.int64)
        begin[p_of[heads]] = starts[heads]
        begin[first[:-1]] = offsets[:-1]
        size = np.diff(np.concatenate((begin, [len(data)])))
        p_byte = np.repeat(np.arange(total), size)
        x[:, :_KINDS] = np.bincount(p_byte * _KINDS + _KIND[data], minlength=total * _KINDS).reshape(total, _KINDS) / np.maximum(size, 1)[:, None]
        words = np.bincount(p_of, minlength=total)
        some = np.maximum(words, 1)
        length = (ends - starts).astype(np.float64)
        mean = np.bincount(p_of, length, total) / some
        at = _KINDS
        x[:, at] = mean / 10
        x[:, at + 1] = np.sqrt(np.maximum(0, np.bincount(p_of, length * length, total) / some - mean * mean)) / 10
        x[:, at + 2] = np.bincount(p_of, length <= 3, total) / some
        x[:, at + 3] = np.log1p(words) / 5
        order = np.lexsort((hashes, p_of))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (p_of[order][1:] != p_of[order][:-1])
        x[:, at + 4] = np.bincount(p_of[order], new, total) / some
        order = np.lexsort((hashes, text_of))  # words new to the whole text, in the passage where they first stand
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])
        x[:, at + 5] = np.bincount(p_of[order], new, total) / some
        x[:, at + 6] = np.repeat(np.log1p(n_passages), n_passages) / 5
        low = (hashes % np.uint64(HASHED)).astype(np.int64)
        sign = np.where((hashes >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
        bag = np.bincount(p_of * HASHED + low, sign, total * HASHED).reshape(total, HASHED)
        x[:, at + 7 :] = bag / np.sqrt(some)[:, None]
        yield x, first


class Model:
    """h = tanh(x W + b); attention over passages softmax(w . (tanh(h V) * sigmoid(h U))); score sigmoid(z . c + d)."""

    def __init__(self, features: int = FEATURES, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.center, self.scale = np.zeros(features), np.ones(features)
        n = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": n(features, HIDDEN), "b": np.zeros(HIDDEN), "V": n(HIDDEN, GATES), "U": n(HIDDEN, GATES), "w": n(GATES), "c": n(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(first)
        xs = (x - self.center) / self.scale
        h = np.tanh(xs @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), n))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -40, 40)))
        return {"xs": xs, "h": h, "v": v, "u": u, "a": a, "z": z, "s": s}

    def gradients(self, f: dict[str, np.ndarray], first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, n = self.p, np.diff(first)
        g = (f["s"] - y) / len(y)
        dz = np.repeat(g[:, None] * p["c"], n, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), n))
        dg = de[:, None] * p["w"]
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["xs"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ g, "d": np.array([g.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = SEED) -> Model:
        """Adam over shuffled batches of bags."""
        every = np.concatenate(bags)
        self.center, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.p["d"][0] = np.log(share / (1 - share))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        r, step = np.random.default_rng(seed), 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = r.permutation(len(bags))
            for at in range(0, len(order), FIT_BATCH):
                own = order[at : at + FIT_BATCH]
                first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in own])))
                g = self.gradients(self.forward(np.concatenate([bags[i] for i in own]), first), first, y[own])
                step += 1
                for k, v in self.p.items():
                    d = g[k] + DECAY * v
                    m[k] = 0.9 * m[k] + 0.1 * d
                    s[k] = 0.999 * s[k] + 0.001 * d * d
                    v -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        out = [self.forward(x, first)["s"] for x, first in passages(texts)]
        return np.concatenate(out) if out else np.zeros(0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of labelled texts. Without both labels present, every text scores the share of label 1 (0.5 without any).

    Labels other than 0 and 1 don't count, and an id that has both teaches nothing.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= FIT_CHARS)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("y").isin(0, 1)).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("id", "y")
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(FIT_TEXTS)
    rows = texts.join(F.broadcast(chosen), "id").collect()
    rows = sorted({(r.id, r.text, int(r.y)) for r in rows})
    model = Model()
    y = np.array([r[2] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        share = y.mean() if len(y) else 0.5
        model.p["c"][:] = 0
        model.p["d"][0] = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
        return model
    bags = []
    for x, first in passages(pa.array([r[1] for r in rows], pa.string())):
        bags += [x[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return model.fit(bags, y)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score of the whole text. Null and empty texts are one empty passage; ids may be null or repeated."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)), pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of documents, learned from labels of documents whose fold is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs.where(fold() != 2), labels.where(fold() != 2))
    out = scores(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
