"""Corpus preparation in five stages: language ID, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm import exact_dup, langid, mixing, near_dup, packing
from pagelathe.llm.scratch import by_ids, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; languages are learned from the stage's own labelled rows.

    Null and empty texts and those without a letter are rejected. Ids play no part; repeated rows are judged alike.
    """
    return langid.drop_unidentified(docs, docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of texts equal but for the case of A-Z.

    Null texts equal empty ones and leave one of them. A row with a null doc_id goes where another of its group has one.
    Rows repeated with id and text leave one; an id on several texts is judged text by text.
    """
    return exact_dup.drop_exact(docs, keep="min")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of texts of similarity 0.8 on five-word shingles.

    Null and empty texts, texts without words and rows with a null doc_id are linked with nothing and stay. A text of fewer
    words is one shingle. Rows of one id are one document: they stay or go together.
    """
    found = written(near_dup.near_duplicates(docs), "near")
    gone = written(found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "near-gone")
    return by_ids(docs, "doc_id", gone, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled to the default source, language and topic shares; topics are learned from the stage's texts.

    Null categories are a category of their own; texts without words carry no tokens and stay; rows with a null doc_id stay;
    rows repeated with an id are drawn alike where their cells are.
    """
    return mixing.sample_mix(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their length bucket and batch. Null texts and texts without words give one
    piece of no tokens, in no batch; ids may be null or repeated."""
    return packing.pack(packing.word_counts(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_batches", pack_batches),
]

#: Compression sizes and hash-drawn samples can't be had in SQL; tests/llm holds a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
