"""Compressed pages as binary columns and files."""

from __future__ import annotations

import gzip
from importlib import import_module
from importlib.util import find_spec

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def pack_gzip(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else gzip.compress(b, 6, mtime=0))


@F.pandas_udf(T.BinaryType())
def pack_zstd(raw: pd.Series) -> pd.Series:
    c = zstandard.ZstdCompressor(level=6)
    return raw.map(lambda b: None if b is None else c.compress(b))


#: Whether this installation has a codec that can't be told by its first bytes; unpack_brotli() names it instead.
BROTLI = next((m for m in ("brotli", "brotlicffi") if find_spec(m)), None)


def _brotli():
    if not BROTLI:
        raise ModuleNotFoundError("brotli pages need the brotli or brotlicffi module")
    return import_module(BROTLI)


@F.pandas_udf(T.BinaryType())
def pack_brotli(raw: pd.Series) -> pd.Series:
    codec = _brotli()
    return raw.map(lambda b: None if b is None else codec.compress(b, quality=6))


@F.pandas_udf(T.BinaryType())
def unpack_brotli(packed: pd.Series) -> pd.Series:
    codec = _brotli()
    return packed.map(lambda b: None if b is None else codec.decompress(b))


@F.pandas_udf(T.BinaryType())
def unpack(packed: pd.Series) -> pd.Series:
    """gzip and zstd are told apart by their first bytes; anything else is returned as it is."""
    d = zstandard.ZstdDecompressor()

    def one(b: bytes | None) -> bytes | None:
        if b is None:
            return None
        if b[:2] == b"\x1f\x8b":
            return gzip.decompress(b)
        return d.decompressobj().decompress(b) if b[:4] == b"\x28\xb5\x2f\xfd" else b

    return packed.map(one)


def compression_ratio(original: Column, packed: Column) -> Column:
    """Saved share in percent; 0 for an empty original."""
    return F.when(original == 0, 0.0).otherwise((1 - packed / original) * 100)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of a folder of compressed pages, by whatever store Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode(unpack("content"), "UTF-8").alias("html"))


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _store(spark, path)
    return fs.exists(where)


def ensure(spark: SparkSession, path: str) -> bool:
    """Makes a folder, with those above it, where there is none; whether it is there now."""
    fs, where = _store(spark, path)
    return fs.mkdirs(where)


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes an object or a folder with all in it; false if there was none."""
    fs, where = _store(spark, path)
    return fs.delete(where, True)
