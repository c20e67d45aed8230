from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagelathe.llm import packing as pk


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample(range(1, 60), 9))
    counts = [r.randrange(1, 50) for _ in lengths]
    for k in (1, 2, 3, 4, 20):
        ends = pk.boundaries(np.array(lengths), np.array(counts), k)
        best = min(padding(lengths, counts, (*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], min(k, 9) - 1))
        assert padding(lengths, counts, ends) == best and len(ends) == min(k, 9) and ends == sorted(ends)


def test_pieces_and_batches(spark, monkeypatch):
    monkeypatch.setattr(pk, "SHARD_ROWS", 13)
    r = random.Random(0)
    rows = [(i, r.choice([0, 1, 5, 40, 100, 250, 100, r.randrange(1, 400)]), "c") for i in range(300)] + [(7, None, "c"), (None, 30, "c"), (3, 30, "c"), (3, 30, "c")]
    got = pk.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, piece string"), max_tokens=100, buckets=4, budget=256).collect()
    pieces = Counter()
    for i, n, _ in rows:
        n = n or 0
        for s in range(0, max(n, 1), 100):
            pieces[(i, s // 100, s, min(100, n - s))] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.n_tokens) for g in got) == pieces
    full = [g for g in got if g.n_tokens]
    assert all(g.batch is None and g.bucket_len == 0 for g in got if not g.n_tokens)
    hist = Counter(g.n_tokens for g in full)
    ends = pk.boundaries(np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)]), 4)
    assert all(g.bucket_len == min(e for e in ends if e >= g.n_tokens) for g in full)
    batches = defaultdict(Counter)
    for g in full:
        batches[g.bucket_len][g.batch] += 1
    for length, sizes in batches.items():
        room = max(1, 256 // length)
        assert sorted(sizes) == list(range(len(sizes)))
        assert all(sizes[b] == room for b in range(len(sizes) - 1)) and 1 <= sizes[len(sizes) - 1] <= room


def test_empty_and_word_counts(spark):
    assert pk.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []
    rows = [(1, "a  b\tc\n"), (2, None), (3, ""), (4, "x y z"), (None, "w " * 70000), (1, "a")]
    got = pk.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, len((t or "").encode().split())) for i, t in rows], key=str)
