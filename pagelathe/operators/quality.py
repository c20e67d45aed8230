"""Row checks and repairs by named rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _names(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items()))) if rules else F.array().cast("array<string>")


def check_rules(df: DataFrame, errors: dict[str, Column], warnings: dict[str, Column] | None = None) -> DataFrame:
    """df with the names of the broken rules in errors and warnings, and valid where no error is."""
    out = df.withColumns({"errors": _names(errors), "warnings": _names(warnings or {})})
    return out.withColumn("valid", F.size("errors") == 0)


def fix_rules(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """df with columns replaced where their rule is broken, and n_fixed, the number of replacements in a row."""
    n = sum((F.coalesce(broken.cast("int"), F.lit(0)) for broken, _ in rules.values()), F.lit(0))
    return df.withColumn("n_fixed", n).withColumns({c: F.when(broken, new).otherwise(F.col(c)) for c, (broken, new) in rules.items()})
