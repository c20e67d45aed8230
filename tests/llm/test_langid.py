from __future__ import annotations

import random
import re
import zlib

import pytest
import zstandard

from pagelathe.llm import langid as li

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_accuracy(spark, docs):
    got = {r.doc_id: r for r in li.op5_langid(spark, SF).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [r for r in got.values() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_equals_a_plain_loop(spark, docs):
    learned = li.learn(docs)
    own = li.Classifier(learned)
    got = {r.doc_id: r.lang_pred for r in li.identify(docs, learned).collect()}
    assert got == {r.doc_id: own.predict(r.text)[0] for r in docs.collect()}


def test_odd_texts(spark, docs):
    learned = li.learn(docs)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "ñ"), (None, "the of and " * 20), (5, "the and of that with " * 40000), (5, "the and of")]
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], "doc_id long, text string, score string, lang_pred string")
    got = li.identify(df, learned).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.margin > 0): r for r in got}
    for i in (1, 2, 3):
        assert by[(i, False)].lang_pred == "und" and by[(i, False)].score == 0 and by[(i, False)].rejected
    assert any(r.doc_id == 4 and r.lang_pred != "und" for r in got)
    assert li.identify(df.limit(0), learned).collect() == []


def test_nothing_learned(spark, docs):
    assert li.learn(docs.limit(0)) == {}
    assert {r.lang_pred for r in li.identify(docs.limit(5), {}).collect()} == {"und"}
    assert {r.lang_pred for r in li.identify(docs.limit(5), {"xx": b"some text of a language"}).collect()} == {"xx"}


def test_drop(spark, docs):
    bad = spark.createDataFrame([(900001, "12 34", None, "s", 5), (900002, None, "en", "s", None), (None, "...", None, None, None)], docs.schema)
    kept = li.drop_unidentified(docs.unionByName(bad), docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {900001, 900002, None} and len(ids) >= 0.98 * docs.count()


def test_long_texts_in_an_unlearned_language_go(spark, docs):
    """The margin grows with the text; clean texts stay at any length, also far beyond the dictionaries."""
    r = random.Random(0)
    finnish = "talo koira kissa vesi tuli maa ilma aurinko kuu tähti metsä järvi joki meri saari vuori kukka puu lintu kala hevonen leipä maito kirja".split()
    consonants = lambda: "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randrange(2, 10)))
    strange = [" ".join(consonants() for _ in range(n)) for n in (200, 500, 1000, 4000) for _ in range(5)] + [" ".join(r.choices(finnish, k=n)) for n in (300, 1000, 20000) for _ in range(5)]
    texts: dict[str, list[str]] = {}
    for row in docs.where("text IS NOT NULL AND lang IS NOT NULL").collect():
        texts.setdefault(row.lang, []).append(row.text)
    clean = [" ".join(r.choices(own, k=k)) for own in texts.values() for k in (5, 50, 500)]
    rows = [(i, t, None, "s", len(t)) for i, t in enumerate(strange + clean)]
    kept = {x.doc_id for x in li.drop_unidentified(spark.createDataFrame(rows, docs.schema), docs).collect()}
    assert kept == set(range(len(strange), len(rows)))


def plain_verdict(text, dictionaries):
    """(language, smallest size, margin) with nothing but the compressor: a version of its own of the rules."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0, 0
    words = re.findall(rb"[A-Za-z\x80-\xff]+", text.lower().encode())
    raw = b"".join(w + b" " for w in words)
    if not words:
        raw = b" "
    for level in (6, 12):
        sizes = {}
        for lang, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False)
            sizes[lang] = sum(len(c.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096))
        least, second = sorted(sizes.values())[:2]
        if second - least > 2:
            break
    return min(sizes, key=lambda x: (sizes[x], x)), least, second - least


def test_equals_an_independent_loop(spark, docs):
    """Language and rejection of every document, computed without the operator's classifier."""
    learned = li.learn(docs)
    got = {r.doc_id: r for r in li.identify(docs, learned).collect()}
    kept = {r.doc_id for r in li.drop_unidentified(docs, docs).collect()}
    for r in docs.collect():
        lang, least, margin = plain_verdict(r.text, learned)
        assert got[r.doc_id].lang_pred == lang
        rejected = lang == "und" or margin < max(1, 0.03 * least)
        assert got[r.doc_id].rejected == rejected == (r.doc_id not in kept)
