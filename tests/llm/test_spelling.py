from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from pagelathe.llm import spelling as sp

SF = "/root/testdata/sf0.001"


def near(a: str, b: str) -> bool:
    """One code point inserted, deleted or replaced, by trying them all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts: dict[str, int], ratio: int = 2) -> set[tuple]:
    plain = [w for w in counts if re.fullmatch("[a-zÀ-ÿ]+", w)]
    links = {w: [] for w in counts}
    for a, b in itertools.combinations(plain, 2):
        if near(a, b):
            links[a].append(b)
            links[b].append(a)
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(links[w]), counts[form[w]] if form[w] else None))
    return out


def words(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("seed", range(3))
def test_variants_against_all_pairs(spark, seed):
    r = random.Random(seed)
    counts = {"".join(r.choice("abÀé") for _ in range(r.randrange(1, 7))): r.choice([1, 2, 3, 4, 8, 8, 30, 100]) for _ in range(250)}
    counts |= {w + "x": 2 * n for w, n in list(counts.items())[:20]}
    assert {tuple(x) for x in sp.variants(words(spark, counts)).collect()} == brute(counts)


def test_letter_order_and_long_chains(spark):
    counts = {"listen": 5, "silent": 50, "listn": 10, "abcdef": 1, "xbcdef": 2, "xycdef": 4, "xyzdef": 8, "xyzuef": 16, "xyzuvf": 32, "xyzuvw": 64, "xyzuvwq": 128, "xyzuvwqq": 256}
    got = {tuple(x) for x in sp.variants(words(spark, counts)).collect()}
    assert got == brute(counts)
    assert ("abcdef", "xbcdef", "xyzuvwqq", 1, 1, 2) in got and ("silent", None, "silent", 50, 0, None) in got


def test_values_have_distinct_differences():
    """So that words meet under one key only: sums of two fifth powers of ranks up to 90 are all different."""
    sums = Counter(a**sp.POWER + b**sp.POWER for a, b in itertools.combinations_with_replacement(range(91), 2))
    assert max(sums.values()) == 1


def plain_counts(rows, least, drop):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if drop and h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                out[run] += 1
    return dict(out)


def test_word_counts(spark, monkeypatch):
    """Whole texts, nulls, repeated rows, letters beyond the alphabet, and texts cut into windows."""
    monkeypatch.setattr(sp, "WINDOW", 64)
    monkeypatch.setattr(sp, "FLUSH", 40)
    r = random.Random(5)
    vocabulary = ["ÉCOLE", "straße", "naïve", "Hello", "don't", "x", "Ωmega", "a÷b", "日本語", "ÿÿÿÿÿ", "wörter"]
    rows = [(i if i % 7 else None, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 30, 400])))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, "z" * 5000 + " tail " * 100), (3, "z" * 5000 + " tail " * 100)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, word string")
    for least, drop in ((1, 0), (5, 3), (2, 97)):
        got = {x.word: x.n for x in sp.word_counts(df, least=least, drop=drop).collect()}
        assert got == plain_counts(rows, least, drop)


def test_odd_tables(spark):
    assert sp.variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert sp.word_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [("hello", 2), ("hello", 3), ("hallo", 20), (None, 5), ("", 9), ("Hello", 90), ("日本語", 7), ("日本", 70), ("e" * 3000, 4), ("e" * 3001, 8)]
    got = {tuple(x) for x in sp.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    counts = {"hello": 5, "hallo": 20, "Hello": 90, "日本語": 7, "日本": 70, "e" * 3000: 4, "e" * 3001: 8}
    assert got == brute(counts)
    with pytest.raises(ValueError):
        sp.variants(spark.createDataFrame(rows, "word string, n long"), ratio=1)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {tuple(x) for x in con.execute(sp.ORACLE).fetchall()}
    df = sp.op11_spelling(spark, SF)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(x) for x in df.collect()} == want and any(x[1] for x in want)
