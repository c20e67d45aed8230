"""Statistics of the graph of path patterns: edges(domain, src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patterns(edges: DataFrame) -> DataFrame:
    """Every pattern that a domain is known to have."""
    return edges.select("domain", F.col("src").alias("pattern")).union(edges.select("domain", "dst")).distinct()


def hubs(edges: DataFrame, least: int = 3, direction: str = "out") -> DataFrame:
    """Patterns with at least so many distinct neighbours in a direction, out or in."""
    own, other = {"out": ("src", "dst"), "in": ("dst", "src")}[direction]
    return edges.groupBy("domain", F.col(own).alias("pattern")).agg(F.count_distinct(other).alias("n")).where(F.col("n") >= least)


def coverage(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """Per domain: total, visited and unvisited patterns, coverage in percent to one place."""
    seen = visited.select("domain", "pattern").distinct().withColumn("seen", F.lit(1))
    g = patterns(edges).join(seen, ["domain", "pattern"], "left").groupBy("domain").agg(F.count("*").alias("total"), F.count("seen").alias("visited"))
    return g.withColumn("unvisited", F.col("total") - F.col("visited")).withColumn("coverage", F.round(100.0 * F.col("visited") / F.col("total"), 1))
