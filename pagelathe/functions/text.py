"""Small text builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def language_header(locale: Column, languages: Column) -> Column:
    """The locale, then up to five other languages with weights from 0.9 down by 0.1."""
    others = F.slice(F.filter(languages, lambda x: x != locale), 1, 5)
    weights = F.array(*(F.lit(w) for w in ("0.9", "0.8", "0.7", "0.6", "0.5")))
    weighed = F.transform(others, lambda x, i: F.concat(x, F.lit(";q="), F.element_at(weights, (i + 1).cast("int"))))
    return F.array_join(F.concat(F.array(locale), weighed), ",")
