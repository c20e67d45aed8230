"""Table functions for SQL: extract_fields(html, url) and html_links(html)."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from pagelathe.operators import selectors as S

_FIELDS = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "value", "selector")])
_LINKS = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("href", T.StringType())])


class ExtractFields:
    """A row for each field that the default selector rules find."""

    def eval(self, html: str, url: str) -> Iterator[tuple[str, str, str]]:
        try:
            host = urlsplit(url or "").hostname or ""
        except ValueError:
            host = ""
        yield from (f[:3] for f in S.fields_of(html, host))


class HtmlLinks:
    """A row for each link target of a page, in order."""

    def eval(self, html: str) -> Iterator[tuple[int, str]]:
        targets = (n.attrs["href"] for n in S.parse(html).by_tag.get("a", ()) if "href" in n.attrs)
        yield from enumerate(targets)


def register(spark: SparkSession) -> None:
    """Makes both functions known to the session's SQL."""
    spark.udtf.register("extract_fields", udtf(ExtractFields, returnType=_FIELDS))
    spark.udtf.register("html_links", udtf(HtmlLinks, returnType=_LINKS))
