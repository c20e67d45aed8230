"""URL lists and pasted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def url_lines(lines: DataFrame, only_http: bool = True) -> DataFrame:
    """Trimmed lines of a column value, blank ones dropped; only_http also drops what doesn't begin with http."""
    out = lines.select(F.trim("value").alias("url")).where("url <> ''")
    return out.where(F.startswith("url", F.lit("http"))) if only_http else out


def read_url_list(spark: SparkSession, path: str, only_http: bool = True) -> DataFrame:
    """A text file of URLs, one on each line, whatever its extension."""
    return url_lines(spark.read.text(path), only_http)


def found_urls(text: Column) -> Column:
    """URLs in a text; without any, the whole text."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s]+"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))
