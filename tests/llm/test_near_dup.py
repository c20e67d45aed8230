from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pagelathe.llm import near_dup as nd
from pagelathe.llm.graph import components
from pagelathe.llm.words import shingle_sets

SCHEMA = "doc_id long, text string, extra string, id string, bucket string"


def brute(rows, n, num=80, den=100):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=str)


def family(r, size, words, share):
    base = [r.choice(VOCAB) for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(int(words * r.uniform(0, share))):
            w[r.randrange(words)] = r.choice(VOCAB)
        out.append(" ".join(w))
    return out


VOCAB = [f"w{i}" for i in range(3000)]


@pytest.mark.parametrize("n", [2, 5])
def test_equals_brute_force(spark, n):
    r = random.Random(n)
    texts = [None, "", " \n\t", "one", "ONE", "one two", "a b c", "A  b\nc", "É b c d e f", "é b c d e f"]
    texts += family(r, 60, 80, 0.12) + family(r, 25, 40, 0.2) + family(r, 10, 8, 0.3)
    texts += [" ".join(r.choice(VOCAB) for _ in range(r.randrange(1, 60))) for _ in range(40)]
    texts += ["x y " * 20000, "x y " * 20000 + "z"]
    texts += texts[20:30]
    r.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "e", "clash", "clash") for i, t in rows], SCHEMA)
    got = nd.near_duplicates(df, n_words=n).collect()
    assert sorted((tuple(g) for g in got), key=str) == brute(rows, n)


@pytest.mark.parametrize("block,large", [(7, 1000), (1024, 5), (16, 2)])
def test_blocks_of_a_large_bucket(spark, monkeypatch, block, large):
    """A family whose members are linked through each other but not with its smallest id."""
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "LARGE", large)
    r = random.Random(3)
    base = [r.choice(VOCAB) for _ in range(100)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(k % 12, k % 12 + 11):
            w[(j * 8) % 100] = f"u{k % 12}-{j}" if k % 3 else f"v{j}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(df, n_words=2).collect()
    assert sorted((tuple(g) for g in got), key=str) == brute(rows, 2)


def test_null_repeated_and_empty(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, None), (3, "A b c d e f")]
    got = sorted((tuple(g) for g in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (2, 0, 2, True), (3, 2, 1, False)], key=str)
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pruning_bound():
    for n in (32, 96, 160):
        m = nd.fewest(n, 80, 100, 1e-6)
        tail = lambda m: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m + 1))
        assert tail(m) >= 1e-6 > tail(m - 1)


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**64, 1000, dtype=np.uint64)
    a, b = np.unique(x[:900]), np.unique(x[100:])
    assert abs((nd.signature(a) == nd.signature(b)).mean() - 0.8) < 0.12


def test_shingles_across_blocks(monkeypatch):
    import pagelathe.llm.words as words

    texts = pa.array(["a b c", None, "d", "A B c", "c " * 50, "a b"])
    whole = [x.tolist() for x in shingle_sets(texts, 2)]
    monkeypatch.setattr(words, "BLOCK_BYTES", 4)
    words._powers.cache_clear()
    assert [x.tolist() for x in shingle_sets(texts, 2)] == whole
    words._powers.cache_clear()
    assert whole[0] == whole[3] and len(whole[0]) == 2 and whole[1] == [] and len(whole[4]) == 1


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 300), (300, 400), (9, 9)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 0, 200: 200, 300: 200, 400: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_id_on_several_texts(spark):
    """An id is one document: its texts lie in one component, with the links of all of them."""
    base = [f"w{i}" for i in range(60)]
    text = lambda *gone: " ".join(f"x{i}" if i in gone else w for i, w in enumerate(base))
    other, third = " ".join(f"y{i}" for i in range(40)), " ".join(f"z{i}" for i in range(40))
    rows = [(1, text()), (1, other), (2, other), (3, text(59)), (4, third), (5, third + " end"), (6, third), (6, "quite alone here"), (7, "alone too")]
    r = random.Random(0)
    for _ in range(2):
        r.shuffle(rows)
        got = {(x.doc_id, x.component_id) for x in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7)}


def test_recall_on_documents(spark):
    """Every pair of documents of sf0.01 at similarity 0.8 lies in one component, and components hold linked pairs only."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    ids, sets = table["doc_id"].to_pylist(), list(shingle_sets(table["text"].combine_chunks(), 2))
    place, rows = {}, defaultdict(list)
    for i, s in enumerate(sets):
        for x in s.tolist():
            rows[x].append(i)
    counts = defaultdict(int)
    for own in rows.values():
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                counts[i, j] += 1
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(i, j) for (i, j), n in counts.items() if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    for i, j in pairs:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    for i in range(len(ids)):
        place.setdefault(find(i), []).append(ids[i])
    want = {i: min(own) for own in place.values() for i in own}
    got = {r.doc_id: r.component_id for r in nd.op2_near_dup(spark, "/root/testdata/sf0.01").collect()}
    assert len(pairs) > 100 and got == want


def test_grid_is_linear_in_a_bucket(spark):
    """A bucket of 5,000 members of which three lie outside the center's component takes 5,000 rows and 5 for each of the three;
    each of the three meets every member in one cell."""
    rows = [(7, 3, i, 0, 5000, i if i in (11, 12, 13) else 0, 0, 3) for i in range(5000)]
    open_ = spark.createDataFrame(rows, "bucket long, band int, id long, center long, m long, label long, main long, k long")
    laid = nd._grid(open_).collect()
    assert len(laid) == 5000 + 3 * 5
    cells = {}
    for x in laid:
        cells.setdefault((x.row, x.col), ([], []))[0 if x.asks else 1].append(x.id)
    met = [(a, b) for asks, asked in cells.values() for a in asks for b in asked]
    assert len(met) == len(set(met)) == 3 * 5000 and max(len(b) for _, b in cells.values()) <= 1200


def test_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(nd, "PART_SHINGLES", 10)
    sizes = np.array([4, 4, 4, 30, 1, 9, 2])
    assert nd._parts(np.array([0, 1, 2, 3, 4, 5, 6, 0, 3]), sizes).tolist() == [0, 0, 1, 2, 3, 3, 4, 0, 2]


@pytest.mark.parametrize("size", [1, 40, 10**6])
def test_texts_in_parts_give_the_same(spark, monkeypatch, size):
    """Whatever the bound on the texts of a part, components are those of brute force."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "PART_SHINGLES", size)
    r = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(60):
        t = list(base)
        for _ in range(r.randrange(0, 7)):
            t[r.randrange(40)] = f"x{r.randrange(12)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in nd.near_duplicates(df, n_words=2).collect()}
    sets = [{tuple(t.split()[i : i + 2]) for i in range(39)} for t in texts]
    want = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert got == dict(enumerate(want)) and 1 < len(set(want)) < 60


def test_long_texts_are_hashed_in_windows(monkeypatch):
    """A text's words have the same hashes in windows as together; a text of 20 MB takes few times its size."""
    import tracemalloc

    from pagelathe.llm import words

    r = random.Random(1)
    text = "".join(r.choice(["wörd ", "x", "\t\n", "ABC ", "long" * 30 + " "]) for _ in range(3000))
    texts = pa.array([text, "a b", "", text[:500]])
    want = [s.tolist() for s in shingle_sets(texts, 2)]
    monkeypatch.setattr(words, "BLOCK_BYTES", 64)
    assert [s.tolist() for s in shingle_sets(texts, 2)] == want
    monkeypatch.undo()
    long = pa.array(["some words " * 1_900_000])
    tracemalloc.start()
    assert len(next(shingle_sets(long, 2))) == 2
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * 21e6
