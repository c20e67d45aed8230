"""All queries of the library by name, with their DuckDB equivalents."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from pagelathe.plans import registry

_MODULES = ["url_queries", "response_queries", "extraction_queries", "aggregate_queries", "relational_queries", "fold_queries", "stream_queries", "adapter_queries"]


def _load() -> None:
    for m in _MODULES:
        import_module(f"pagelathe.plans.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return registry.QUERIES["flagship_topics"](spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
