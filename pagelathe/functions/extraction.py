"""Extraction from HTML and text with built-in functions: visible text, JSON-LD, prices and identifiers, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns tried in order; the first that matches counts.
PRICE = [r"\$\s?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)", r"€\s?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)", r"(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s?(?:USD|EUR|GBP)"]
SKU = [r"(?i)SKU[:\s]*([A-Z0-9\-]{4,})", r"(?i)Item\s*#[:\s]*([A-Z0-9\-]{4,})", r"(?i)Model[:\s]*#?[:\s]*([A-Z0-9\-]{4,})"]
RATING = r"(?i)(\d\.?\d?)\s*(?:out of|stars?|rating)"
REVIEWS = r"(?i)(\d{1,3}(?:,\d{3})*)\s*(?:review|rating)"
JSON_LD = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
DATE = r"(\d{4}[-/]\d{2}[-/]\d{2}\s*\d{2}:\d{2})"
RELATIVE_DATE = r"(\d+[小分钟天]前)"
# Node types that carry fields.
PRODUCT_TYPES = ["Product", "ProductGroup", "IndividualProduct", "ProductModel"]
OFFER_TYPES = ["Offer", "AggregateOffer"]
ORGANIZATION_TYPES = ["Organization", "Brand"]
# The fields of a complete product, in the order in which missing ones are listed.
REQUIRED = ["title", "price", "brand", "sku", "description", "image"]


# What visible text leaves out, and where links stand.
SCRIPT, STYLE, TAG = r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"<[^>]+>"
LINK = r'(?i)<a\s[^>]*href="([^"]*)"'


def html_strip(html: Column) -> Column:
    """Visible text: scripts, styles and tags dropped, white space collapsed; entities stay as they are."""
    text = F.regexp_replace(F.regexp_replace(html, SCRIPT, ""), STYLE, "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, TAG, " "), r"\s+", " "))


def ws_norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_match(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches anywhere, null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def price(text: Column) -> Column:
    return F.replace(first_match(text, PRICE), F.lit(","), F.lit("")).try_cast("double")


def sku(text: Column) -> Column:
    return first_match(text, SKU)


def rating(text: Column) -> Column:
    return first_match(text, [RATING]).try_cast("double")


def reviews(text: Column) -> Column:
    return F.replace(first_match(text, [REVIEWS]), F.lit(","), F.lit(""))


def money(text: Column) -> tuple[Column, Column]:
    """A money string as number, and the string itself where it is none."""
    number = F.translate(text, "$€,", "").try_cast("double")
    return number, F.when(number.isNull(), text)


def date(text: Column) -> Column:
    return first_match(text, [DATE, RELATIVE_DATE])


def json_ld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(LINK), F.lit(1))


# The members of a node, of an offer and of a rating that fields are read from.
_NODE = ["@type", "name", "description", "sku", "brand", "image", "category", "gtin12", "upc", "gtin13", "ean", "aggregateRating", "offers", "price", "priceCurrency", "availability", "priceValidUntil"]
_OFFER = ["price", "priceCurrency", "availability", "priceValidUntil"]
_RATING = ["ratingValue", "reviewCount"]


def _members(value: Column, names: list[str], path: str = "$") -> Column:
    """An object's members as a struct of variants, by one cast; null for anything else."""
    return F.try_variant_get(value, path, "struct<" + ", ".join(f"`{n}`: variant" for n in names) + ">")


def _text(*found: tuple[Column, str]) -> Column:
    """The first of some places in small variants that holds a scalar, as string."""
    return F.coalesce(*(F.nullif(F.try_variant_get(v, path, "string"), F.lit("")) for v, path in found))


def node_type(node: Column) -> Column:
    """The type of a node; of a list the first."""
    return F.coalesce(F.try_variant_get(node, "$['@type'][0]", "string"), F.try_variant_get(node, "$['@type']", "string"))


def nodes(html: Column) -> Column:
    """The JSON-LD nodes of a page in order as an array of variants; a graph gives its members, broken blocks nothing."""
    parsed = F.filter(F.transform(json_ld_blocks(html), lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    graph = lambda v: F.try_variant_get(v, "$['@graph']", "array<variant>")
    return F.flatten(F.transform(parsed, lambda v: F.coalesce(graph(v), F.array(v))))


def _typed(all_: Column) -> Column:
    """Nodes as (node, kind, offer, rating): the members of each as a struct, its type, of a list the first, and the members of
    its offer, of a list the first, and of its rating."""
    cast = F.transform(all_, lambda n: F.struct(_members(n, _NODE).alias("node")))
    kind = lambda n: F.coalesce(F.try_variant_get(n["@type"], "$[0]", "string"), F.try_variant_get(n["@type"], "$", "string"))
    offer = lambda n: F.coalesce(_members(n["offers"], _OFFER), _members(n["offers"], _OFFER, "$[0]"))
    return F.transform(cast, lambda x: F.struct(x["node"].alias("node"), kind(x["node"]).alias("kind"), offer(x["node"]).alias("offer"), _members(x["node"]["aggregateRating"], _RATING).alias("rating")))


def node_fields(x: Column) -> Column:
    """Fields of a node (see _typed) in order: array of (name, value); values that are null or empty are left out."""
    node, kind = x["node"], x["kind"]
    pair = lambda name, *found: F.struct(F.lit(name).alias("name"), _text(*found).alias("value"))
    present = lambda *pairs: F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())
    named = lambda v: [(v, "$.name"), (v, "$[0].name")]

    def offer(o: Column) -> list[Column]:
        return [
            pair("price", (o["price"], "$")),
            pair("currency", (o["priceCurrency"], "$")),
            pair("availability", (o["availability"], "$.name"), (o["availability"], "$")),
            pair("price_valid_until", (o["priceValidUntil"], "$")),
        ]

    product = [
        pair("title", (node["name"], "$")),
        pair("description", (node["description"], "$")),
        pair("sku", (node["sku"], "$")),
        pair("brand", *named(node["brand"])),
        pair("image", (node["image"], "$[0].url"), (node["image"], "$[0]"), (node["image"], "$")),
        pair("category", *named(node["category"]), (node["category"], "$")),
        pair("upc", (node["gtin12"], "$"), (node["upc"], "$")),
        pair("ean", (node["gtin13"], "$"), (node["ean"], "$")),
        pair("rating_value", (x["rating"]["ratingValue"], "$")),
        pair("review_count", (x["rating"]["reviewCount"], "$")),
    ]
    none = F.array().cast("array<struct<name:string,value:string>>")
    return F.when(kind.isin(PRODUCT_TYPES), present(*product, *offer(x["offer"]))).when(kind.isin(OFFER_TYPES), present(*offer(node))).when(kind.isin(ORGANIZATION_TYPES), present(pair("brand", (node["name"], "$")))).otherwise(none)


def first_wins(pairs: Column) -> Column:
    """A map of an array of (name, value): the first value of each name. pairs is evaluated once."""
    put = lambda acc, p: F.when(F.map_contains_key(acc, p["name"]), acc).otherwise(F.map_concat(acc, F.create_map(p["name"], p["value"])))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), put)


def json_ld_fields(html: Column) -> Column:
    """The first value of each field over all nodes of a page, as a map."""
    return first_wins(F.flatten(F.transform(_typed(nodes(html)), node_fields)))


def heuristic_fields(text: Column) -> Column:
    """Fields found in visible text by patterns, as array of (name, value, confidence)."""
    found = {"price": price(text).cast("string"), "sku": sku(text), "rating_value": rating(text).cast("string"), "review_count": reviews(text)}
    rows = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(0.5).alias("confidence")) for n, v in found.items()))
    return F.filter(rows, lambda r: r["value"].isNotNull())


def missing(names: Column) -> Column:
    """The required fields that an array of names lacks, in their order."""
    return F.filter(F.array(*map(F.lit, REQUIRED)), lambda f: ~F.array_contains(names, f))


def merge(incoming: Column) -> Column:
    """Fields after merging an ordered array of (name, value, confidence): a later field replaces an earlier one only if
    its own confidence is above 0.7, whatever the earlier one's is."""

    def step(acc: Column, x: Column) -> Column:
        old = F.try_element_at(acc, x["name"])
        new = F.create_map(x["name"], x["value"])
        return F.when(old.isNull() | (x["confidence"] > 0.7), F.map_concat(F.map_filter(acc, lambda k, v: k != x["name"]), new)).otherwise(acc)

    return F.aggregate(incoming, F.create_map().cast("map<string,string>"), step)


def merge_best(incoming: Column) -> Column:
    """Like merge(), but the value of the highest confidence wins, the earliest of equal ones."""
    names = F.array_distinct(F.transform(incoming, lambda x: x["name"]))

    def best(n: Column) -> Column:
        own = F.filter(incoming, lambda x: x["name"] == n)
        top = F.array_max(F.transform(own, lambda x: x["confidence"]))
        return F.element_at(F.filter(own, lambda x: x["confidence"] == top), 1)["value"]

    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, best(n))))

