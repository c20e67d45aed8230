from __future__ import annotations

import math
import os
import random

import pytest
from tokenizers import Tokenizer, models, normalizers

from pagelathe.llm import token_count as tc

PATH = os.path.join(tc.FOLDER, tc.MODEL)


def reference(pieces, has_bytes):
    vocab = [("<unk>", min(s for _, s in pieces))] + ([(f"<0x{b:02X}>", 0.0) for b in range(256)] if has_bytes else []) + pieces
    t = Tokenizer(models.Unigram(vocab, 0, has_bytes))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(tc.SPACE), normalizers.Replace(" ", tc.SPACE)])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids) if text else 0


TEXTS = ["a", " ", "  ", "a  b", " lead", "trail ", "tab\tand\nline\n\n", "ünïcödé ñandú", "日本語テキスト", "🙂🙂x🙂", "\x00\x01", "mixed 日 🙂 word", "▁▁raw▁", "x" * 300, "the  the   the    the", "\n", "a\n b"]


@pytest.fixture(scope="module")
def real():
    return tc.vocabulary(PATH)


def texts(seed, letters, n=300):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def test_equals_the_tokenizer(real):
    own, expected = tc.Counter(*real), reference(*real)
    some = TEXTS + texts(1, "abcdefgh  \n") + texts(2, "étha in.,0129 ñ日\U0001f642") + ["of the reoush tionhe ing" * 50]
    assert [own.count(t) for t in some] == [expected(t) for t in some]
    assert own.count(None) == own.count("") == 0


@pytest.mark.parametrize("has_bytes", [True, False])
@pytest.mark.parametrize("seed", range(4))
def test_ties_go_as_in_the_tokenizer(seed, has_bytes):
    """Equal scores everywhere, pieces across spaces too, and characters without a piece."""
    r = random.Random(seed)
    pieces = {c: 0.0 for c in "abc" + tc.SPACE * (seed % 2)}
    while len(pieces) < 40:
        pieces["".join(r.choice("abc" + tc.SPACE) for _ in range(r.randrange(1, 5)))] = float(-r.randrange(0, 3))
    pieces = list(pieces.items())
    own, expected = tc.Counter(pieces, has_bytes), reference(pieces, has_bytes)
    some = texts(seed, "abc zé")
    assert [own.count(t) for t in some] == [expected(t) for t in some]


def test_memory_is_bounded(real, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 5)
    own, expected = tc.Counter(*real), reference(*real)
    text = " ".join(f"word{i}" for i in range(50))
    assert own.count(text) == expected(text) and len(own) <= 5


def test_frame(spark, real):
    expected = reference(*real)
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(None, "x", "c"), (1, None, "c"), (1, "", "c"), (2, "the and " * 40000, "c")]
    got = tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, expected(t)) for i, t, _ in rows), key=str)
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_table_of_unigram_scores(spark, tmp_path):
    """Log probabilities from a .vocab table, with and without bytes: counts are those of the Unigram model on them."""
    words = ["▁the", "▁of", "▁", "the", "tion", "re", "in", "ing", "e", "t", "h", "i", "n", "g", "o", "f", "r", "s", "▁thing", "thing", "日本", "日"]
    scores = [(w, math.log((i % 7 + 1) / 60)) for i, w in enumerate(words)]
    for has_bytes in (False, True):
        rows = [("<unk>", 0.0), ("<s>", 0.0), *([(f"<0x{b:02X}>", 0.0) for b in range(256)] if has_bytes else []), *scores]
        path = str(tmp_path / f"model{has_bytes:d}.vocab")
        with open(path, "w", encoding="utf-8") as f:
            f.write("".join(f"{p}\t{s!r}\n" for p, s in rows))
        pieces, found = tc.vocabulary(path)
        assert pieces == scores and found == has_bytes
        some = ["the thing of the tions", "rethinging", "日本語 xyz", "", None, *texts(3, "thingofres 日x")]
        expected = reference(scores, has_bytes)
        df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
        got = {r.doc_id: r.n_tokens for r in tc.token_counts(df, path=path).collect()}
        assert [got[i] for i in range(len(some))] == [expected(t or "") for t in some]
