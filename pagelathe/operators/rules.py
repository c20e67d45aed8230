"""Extraction rules by domain and path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.functions import urls as U


def rules_for(pages: DataFrame, rules: DataFrame, url: str = "url", how: str = "inner") -> DataFrame:
    """Pages with the rules of their domain whose pattern their path begins with.

    An equi-join on the domain with the pattern as residual; the planner broadcasts the rules while they are small.
    """
    r = rules.withColumn("__re", U.pattern_regex(F.col("path_pattern")))
    p = pages.withColumns({"__host": U.host(F.col(url)), "__path": U.path(F.col(url))})
    return p.join(r, (F.col("__host") == F.col("domain")) & F.expr("__path RLIKE __re"), how).drop("__host", "__path", "__re")


def matching(paths: DataFrame, patterns: DataFrame, path: str = "path", pattern: str = "path_pattern") -> DataFrame:
    """Every row of paths with each pattern that its path begins with.

    A pattern's literal beginning, up to its first placeholder, is a join key: a path meets it by its own beginnings of the
    lengths that literals have, so the join is by equality and the regular expression is tried only on what it yields. The
    lengths are one row of distinct numbers, bounded by the longest pattern. Null paths and patterns match nothing.
    """
    literal = F.regexp_extract(pattern, r"^[^{*]*", 0)
    known = patterns.where(F.col(pattern).isNotNull()).withColumns({"__literal": literal, "__re": U.pattern_regex(F.col(pattern))})
    lengths = known.agg(F.coalesce(F.collect_set(F.length("__literal")), F.array().cast("array<int>")).alias("__lengths"))
    each = paths.join(F.broadcast(lengths)).withColumn("__begin", F.explode(F.transform(F.filter("__lengths", lambda n: n <= F.length(path)), lambda n: F.substring(F.col(path), F.lit(1), n))))
    return each.join(known, F.col("__begin") == F.col("__literal")).where(F.expr(f"`{path}` RLIKE __re")).drop("__lengths", "__begin", "__literal", "__re")
