"""Topics of texts: spherical k-means on hashed bags of words, fitted on all texts and given to every whole text.

Bags are written once. Each pass over them is a Spark job whose partitions send sums of bounded size: frequencies of words, the
texts that are drawn as first centers, then the sums of a round. Sums are of whole numbers and draws are hashes, so the
result does not depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.scratch import discard, written
from pagelathe.llm.words import blocks, mix, word_hashes

#: Topics, hashed words, rounds of k-means at most, first centers that a pass draws, and the units of a summed weight.
TOPICS, HASHED, ROUNDS, DRAWN, UNIT = 12, 4096, 12, 4, 1 << 24
#: The topic of a text without words, and of every text where nothing was learned.
NO_TOPIC = "(none)"
_NO_CENTERS = np.zeros((0, HASHED))


class Topics(NamedTuple):
    """Weights of hashed words, and a center of unit length for each topic."""

    idf: np.ndarray
    centers: np.ndarray


def _bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words of each text; then for each distinct hashed word of a text: text, word, count) of consecutive texts."""
    for _, data, offsets in blocks(texts):
        h, index = word_hashes(data, offsets)
        own = np.diff(index)
        text = np.repeat(np.arange(len(own)), own)
        pairs, n = np.unique(text * HASHED + (h % np.uint64(HASHED)).astype(np.int64), return_counts=True)
        yield own, pairs // HASHED, pairs % HASHED, n


def bagged(docs: DataFrame, row: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of a row's own columns (row), hash, words (n_tokens) and bag of hashed words; null texts have none."""
    rows = docs.select(row.alias("row"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for own, text, word, n in _bags(batch.column(2)):
                ends = np.searchsorted(text, np.arange(len(own) + 1))
                # bytes, since rows of arrays are read number by number
                lists = [pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (word.astype(np.int16), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(own)) for i in (0, 1)), pa.array(own, pa.int64()), *lists], ["row", "h", "n_tokens", "words", "counts"])
                at += len(own)
        pa.default_memory_pool().release_unused()

    kind = rows.schema["row"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"row {kind}, h long, n_tokens long, words binary, counts binary"), "topic-bags")


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, count) for each distinct hashed word of the bags in a batch."""
    words, counts = (b"".join(batch.column(c).to_pylist()) for c in ("words", "counts"))
    sizes = pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False) // 2
    return np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(words, np.int16).astype(np.int64), np.frombuffer(counts, np.int32)


def _scores(text: np.ndarray, word: np.ndarray, weight: np.ndarray, rows: int, centers: np.ndarray) -> np.ndarray:
    """Products of texts and centers, each summed in the order of the text's words, whatever stands beside it."""
    return np.stack([np.bincount(text, weight * center[word], rows) for center in centers], axis=1)


def _unit(text: np.ndarray, word: np.ndarray, n: np.ndarray, rows: int, idf: np.ndarray) -> np.ndarray:
    weight = np.log1p(n) * idf[word]
    return weight / (np.sqrt(np.bincount(text, weight * weight, rows)) + 1e-9)[text]


def _summed(rows: DataFrame, topics: int) -> dict[int, tuple[int, np.ndarray]]:
    """{key: (n, sums)} of rows (key, n, sums as bytes of whole numbers), added up key by key, a row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _out(_add({}, ((k, n, np.frombuffer(x, np.int64)) for b in batches for k, n, x in zip(*(c.to_pylist() for c in b.columns), strict=True))))

    found = rows.repartition(topics, "key").mapInArrow(run, rows.schema).collect()
    return {r.key: (r.n, np.frombuffer(r.sums, np.int64)) for r in found}


def _add(held: dict, more) -> dict:
    for k, n, x in more:
        if k in held:
            held[k] = held[k][0] + n, held[k][1] + x
        else:
            held[k] = n, x
    return held


def _out(held: dict) -> Iterator[pa.RecordBatch]:
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([x.astype(np.int64).tobytes() for _, x in held.values()], pa.binary())], ["key", "n", "sums"])


SUMS = "key int, n long, sums binary"


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        _, word, _ = _pairs(batch)
        _add(held, [(0, int(np.count_nonzero(batch.column("n_tokens").to_numpy())), np.bincount(word, minlength=HASHED))])
    yield from _out(held)


def _round(model):
    """Sums, in whole units, of the texts that are nearest to each center, of equally near ones the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centers = model.value
        sums, size = np.zeros((len(centers), HASHED)), np.zeros(len(centers), np.int64)
        for batch in batches:
            text, word, n = _pairs(batch)
            weight = _unit(text, word, n, batch.num_rows, idf)
            own = _scores(text, word, weight, batch.num_rows, centers).argmax(axis=1)
            size += np.bincount(own[batch.column("n_tokens").to_numpy() > 0], minlength=len(centers))
            # doubles hold whole numbers below 2**53 exactly, so a task may have 2**29 texts
            sums += np.bincount(own[text] * HASHED + word, np.rint(weight * UNIT), sums.size).reshape(sums.shape)
        yield from _out({k: (int(size[k]), sums[k]) for k in range(len(centers)) if size[k]})

    return run


def _least(rows: list[tuple], m: int) -> list[tuple]:
    """The m rows (race, h, words, counts) of the smallest race, one for each hash."""
    out: list[tuple] = []
    for r in sorted(rows, key=lambda r: r[:2]):
        if len(out) < m and (not out or out[-1][1] != r[1]):
            out.append(r)
    return out


RACE = "race double, h long, words binary, counts binary"


def _races(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = (pa.float64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["race", "h", "words", "counts"])


def _draw(model, salt: int, m: int):
    """m texts drawn with chances in proportion to their distance from the nearest center, by races of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centers = model.value
        held: list[tuple] = []
        for batch in batches:
            text, word, n = _pairs(batch)
            near = _scores(text, word, _unit(text, word, n, batch.num_rows, idf), batch.num_rows, centers).max(axis=1) if len(centers) else np.zeros(batch.num_rows)
            h = batch.column("h").to_numpy()
            u = ((mix(h.view(np.uint64) + np.uint64(salt)) >> np.uint64(11)).astype(float) + 1) / 2**53
            far = np.where((batch.column("n_tokens").to_numpy() > 0) & (near < 1 - 1e-6), np.maximum(1 - near, 1e-6), 0)
            race = np.divide(-np.log(u), far, out=np.full(len(far), np.inf), where=far > 0)
            some = [i for i in np.lexsort((h, race))[: 64 * m].tolist() if race[i] < np.inf]
            new = _least([(float(race[i]), int(h[i]), i, None) for i in some], m)
            held = _least(held + [(r, x, batch.column("words")[i].as_py(), batch.column("counts")[i].as_py()) for r, x, i, _ in new], m)
        yield from _races(held)

    return run


def _merge(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                held = _least([*held, tuple(c[i].as_py() for c in batch.columns)], m)
        yield from _races(held)

    return run


def fit(bags: DataFrame, topics: int = TOPICS) -> Topics | None:
    """k-means of all bags of a written table, from texts drawn far apart; topics are numbered from the largest to the smallest.
    None where there are no words. The driver sees centers and sums only."""
    share = bags.sparkSession.sparkContext.broadcast
    n, df = _summed(bags.select("n_tokens", "words", "counts").mapInArrow(_frequencies, SUMS), 1).get(0, (0, None))
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    centers = _NO_CENTERS
    while len(centers) < topics:
        m, model = min(DRAWN, topics - len(centers)), share((idf, centers))
        drawn = bags.mapInArrow(_draw(model, len(centers), m), RACE).repartition(1).mapInArrow(_merge(m), RACE).collect()
        new = np.zeros((len(drawn), HASHED))
        for x, r in zip(new, sorted(drawn, key=lambda r: (r.race, r.h)), strict=True):
            word = np.frombuffer(r.words, np.int16).astype(np.int64)
            x[word] = _unit(np.zeros(len(word), np.int64), word, np.frombuffer(r.counts, np.int32), 1, idf)
        centers = np.concatenate([centers, new])
        if len(drawn) < m:
            break
    size = np.zeros(len(centers), np.int64)
    for _ in range(ROUNDS):
        found = _summed(bags.select("n_tokens", "words", "counts").mapInArrow(_round(share((idf, centers))), SUMS), topics)
        after, size = centers.copy(), np.zeros(len(centers), np.int64)
        for k, (count, sums) in found.items():
            after[k], size[k] = sums / max(float(np.linalg.norm(sums.astype(float))), 1e-9), count
        settled, centers = np.array_equal(after, centers), after
        if settled:
            break
    return Topics(idf, centers[np.argsort(-size, kind="stable")])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topics: int = TOPICS) -> Topics | None:
    """Topics of all texts of docs; None where they have no words."""
    bags = bagged(docs, F.lit(0), id_col, text_col)
    model = fit(bags, topics)
    discard(bags)
    return model


def assigned(bags: DataFrame, model: Topics | None) -> DataFrame:
    """(row, n_tokens, topic) of a bagged() table."""
    kind = bags.schema["row"].dataType.simpleString()
    shared = bags.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = _names(*_pairs(batch), batch.column("n_tokens").to_numpy(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_tokens"), pa.array(names, pa.string())], ["row", "n_tokens", "topic"])

    return bags.mapInArrow(run, f"row {kind}, n_tokens long, topic string")


def _names(text: np.ndarray, word: np.ndarray, n: np.ndarray, words: np.ndarray, model: Topics | None) -> list[str]:
    """The topic of each text, of equally near ones the larger; a text's length scales all its scores alike."""
    if model is None:
        return [NO_TOPIC] * len(words)
    scores = _scores(text, word, np.log1p(n) * model.idf[word], len(words), model.centers)
    return [f"topic-{t:02d}" if w else NO_TOPIC for t, w in zip(scores.argmax(axis=1).tolist(), words.tolist(), strict=True)]


def topics_of(texts: pa.Array, model: Topics | None) -> tuple[np.ndarray, list[str]]:
    """(words, topic) of each text."""
    words, names = [np.zeros(0, np.int64)], []
    for own, text, word, n in _bags(texts):
        words.append(own)
        names += _names(text, word, n, own, model)
    return np.concatenate(words), names


def word_counts_and_topics(docs: DataFrame, model: Topics | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, topic) in one reading of each text; null texts have no words."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, names = topics_of(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(names, pa.string())], [id_col, "n_tokens", "topic"])
        pa.default_memory_pool().release_unused()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, topic string")
