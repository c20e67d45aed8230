"""Places for model-backed extraction. The library calls no model; callers pass a function of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions import urls as U

#: Characters of a page that a rule model is shown.
SHOWN = 15_000
#: First URLs of kinds are broadcast only up to so many; beyond, both sides of their join are shuffled.
BROADCAST_KINDS = 50_000


def heal_rules(pages: DataFrame, known: DataFrame, model: Callable[[Column], Column], url: str = "url", html: str = "html") -> DataFrame:
    """(domain, path_pattern, rules) for the kinds of page that known(domain, path_pattern) lacks.

    model maps the beginning of a page to its rules. It is asked once for each domain and pattern, with the page of the
    smallest URL (of several pages of that URL, the smallest): the pages are reduced before the call, so no lock is needed.
    URLs alone are reduced to a kind's first; only its pages are then read.
    """
    from pagelathe.sources.stored import stored

    p = pages.select(U.domain(F.col(url)).alias("domain"), U.path_pattern(U.path(F.col(url))).alias("path_pattern"), F.col(url).alias("u"), F.substring(html, 1, SHOWN).alias("shown"))
    kinds = p.groupBy("domain", "path_pattern").agg(F.min("u").alias("u"))
    kinds = stored(kinds.join(known.select("domain", "path_pattern").distinct(), ["domain", "path_pattern"], "left_anti"), "kinds").where("u IS NOT NULL")
    firsts = kinds.select("u").distinct()
    one = p.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_KINDS else firsts, "u").join(kinds, ["domain", "path_pattern", "u"], "left_semi")
    one = one.groupBy("domain", "path_pattern").agg(F.min("shown").alias("shown"))
    return one.select("domain", "path_pattern", model(F.col("shown")).alias("rules"))


def read_screenshots(shots: DataFrame, model: Callable[[Column], Column], content: str = "content") -> DataFrame:
    """shots with the fields that a model reads from an image: array of (name, value), given confidence 0.85."""
    found = F.transform(model(F.col(content)), lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value"), F.lit(0.85).alias("confidence")))
    return shots.withColumn("fields", F.coalesce(found, F.array().cast("array<struct<name:string,value:string,confidence:double>>")))
