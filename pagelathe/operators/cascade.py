"""The extraction cascade over pages: structured data, selectors, then patterns in visible text, merged page by page.

Everything is local to a row: one scan, no shuffle. A tier is asked only while fewer than ENOUGH fields have been found, so a
page that structured data describes is never parsed by Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions import extraction as X
from pagelathe.functions import urls as U
from pagelathe.operators.model_tiers import heal_rules
from pagelathe.operators.selectors import RULES, host_of, selected
from pagelathe.sources.stored import stored

#: Kinds of page are broadcast only up to so many; beyond, both sides of their join are shuffled.
BROADCAST_KINDS = 200_000
#: A source is asked only while fewer distinct fields than this have been found.
ENOUGH = 4
_FIELD = "array<struct<name:string,value:string,confidence:double>>"


def _count(fields: Column) -> Column:
    return F.size(F.array_distinct(F.transform(fields, lambda f: f["name"])))


def extract(
    pages: DataFrame,
    id_col: str,
    html_col: str = "html",
    url_col: str = "url",
    model: Callable[[Column, Column], Column] | None = None,
    rules: Column | None = None,
    entities: Callable[[Column], Column] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per row of pages: id, fields (map), missing (array), n_fields, success, extractors (array of the sources that gave
    fields), and the columns named by keep.

    Sources are taken in order until ENOUGH fields are there: JSON-LD; rules (a column of type selectors.RULES), then the
    default selectors; entities(visible text), a tagger that gives array<struct<name,value>> at confidence 0.7, then
    patterns. model(html, url) is a last source of array<struct<name,value,confidence>>, asked only for pages with missing
    fields. Rows stay rows: a repeated or null id, a null page and a page without fields (an empty map) each keep theirs;
    nothing is invented. An empty table gives an empty result.
    """
    none = F.array().cast(_FIELD)
    html = F.col(html_col)
    ld = F.coalesce(F.transform(F.map_entries(X.json_ld_fields(html)), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), F.lit(1.0).alias("confidence"))), none)
    kept = [F.col(c) for c in (keep or [])]
    out = pages.select(F.col(id_col), *kept, html.alias("__html"), F.col(url_col).alias("__url"), (F.lit(None).cast(RULES) if rules is None else rules).alias("__rules"), ld.alias("__ld"))
    needed = F.when(_count(F.col("__ld")) < ENOUGH, F.col("__html"))
    out = out.withColumn("__css", selected(needed, host_of(F.col("__url")), F.col("__rules")))
    css = F.transform("__css", lambda f: F.struct(f["name"], f["value"], f["confidence"]))
    out = out.withColumn("__two", F.concat("__ld", css))
    ask_text = _count(F.col("__two")) < ENOUGH
    text = X.html_strip(F.when(ask_text, F.col("__html")))
    found = F.coalesce(X.heuristic_fields(text), none)
    if entities:
        named = F.coalesce(F.transform(entities(text), lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value"), F.lit(0.7).alias("confidence"))), none)
        found = F.concat(named, F.filter(found, lambda f: ~F.exists(named, lambda n: n["name"] == f["name"])))
    out = out.withColumn("__text", F.when(ask_text, found).otherwise(none)).withColumn("__all", F.concat("__two", "__text"))
    if model:
        lacks = F.size(X.missing(F.transform("__all", lambda f: f["name"]))) > 0
        out = out.withColumn("__all", F.concat("__all", F.when(lacks, F.coalesce(model(F.col("__html"), F.col("__url")), none)).otherwise(none)))
    used = [F.when(F.size("__ld") > 0, "structured"), F.when(F.size("__css") > 0, "selectors"), F.when(F.size("__text") > 0, "patterns")]
    out = out.select(id_col, *kept, X.merge(F.col("__all")).alias("fields"), F.array_compact(F.array(*used)).alias("extractors"))
    return out.select(id_col, "fields", X.missing(F.map_keys("fields")).alias("missing"), F.size("fields").alias("n_fields"), (F.size("fields") > 0).alias("success"), "extractors", *kept)


def with_rules(pages: DataFrame, cache: DataFrame, now: Column, url_col: str = "url") -> DataFrame:
    """pages with __domain, __pattern and __known: the live rules of their kind in cache(domain, path_pattern, rules, expires_at).

    Of several live entries of a kind the one that expires last counts; a page without one has null rules.
    """
    live = cache.where(F.col("expires_at") > now).groupBy(F.col("domain").alias("__domain"), F.col("path_pattern").alias("__pattern")).agg(F.max_by("rules", "expires_at").alias("__known"))
    url = F.col(url_col)
    return pages.withColumns({"__domain": U.domain(url), "__pattern": U.path_pattern(U.path(url))}).join(live, ["__domain", "__pattern"], "left")


def extract_and_heal(pages: DataFrame, cache: DataFrame, now: Column, model: Callable[[Column], Column], id_col: str, html_col: str = "html", url_col: str = "url", ttl: str = "INTERVAL 24 HOURS") -> tuple[DataFrame, DataFrame]:
    """(extract() of pages by their cached rules and, where fields are missing, by healed ones; entries to add to cache).

    model maps the beginning of a page to rules of type selectors.RULES. It is asked once for each kind of page that has
    missing fields and no live entry; its answer, if it holds a rule, is to be cached for ttl. Then the selectors run again
    on the pages of that kind with missing fields, and only on those. Kinds whose answer is empty are asked again next time.

    The first extraction is written once, with the page only where healing may read it, and the answers are written too; kinds
    are few and many pages share one, so pages are not shuffled by kind unless there are more than BROADCAST_KINDS.
    """
    known = with_rules(pages.withColumns({"__h": F.col(html_col), "__u": F.col(url_col)}), cache, now, url_col)
    first = extract(known, id_col, html_col, url_col, rules=F.col("__known"), keep=["__h", "__u", "__domain", "__pattern", "__known"])
    may = (F.size("missing") > 0) & F.col("__known").isNull()
    first = stored(first.withColumn("__may", may).withColumn("__h", F.when(F.col("__may"), F.col("__h"))).drop("__known"), "first")
    fresh = stored(heal_rules(first.where("__may"), cache.where(F.col("expires_at") > now), model, "__u", "__h").where(F.size("rules") > 0), "healed")
    added = fresh.withColumn("expires_at", now + F.expr(ttl))
    healed = fresh.select(F.col("domain").alias("__domain"), F.col("path_pattern").alias("__pattern"), F.col("rules").alias("__healed"))
    again = first.join(F.broadcast(healed) if fresh.count() <= BROADCAST_KINDS else healed, ["__domain", "__pattern"], "left")
    ask = F.when((F.size("missing") > 0) & F.col("__healed").isNotNull(), F.col("__h"))
    again = again.withColumn("__more", selected(ask, host_of(F.col("__u")), F.col("__healed")))
    entries = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), F.lit(0.0).alias("confidence")))
    more = F.transform("__more", lambda f: F.struct(f["name"], f["value"], f["confidence"]))
    again = again.withColumn("fields", X.merge(F.concat(entries, more)))
    used = F.when(F.size("__more") > 0, F.array_union("extractors", F.array(F.lit("healed")))).otherwise(F.col("extractors"))
    out = again.select(id_col, "fields", X.missing(F.map_keys("fields")).alias("missing"), F.size("fields").alias("n_fields"), (F.size("fields") > 0).alias("success"), used.alias("extractors"))
    return out, added
