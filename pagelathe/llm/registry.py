"""The queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module that holds the function of that name (and ORACLE, if SQL can express it).
_WHERE = {
    "op1_pack": "packing",
    "op2_near_dup": "near_dup",
    "op3_exact_dup": "exact_dup",
    "op4_pii": "pii",
    "op5_langid": "langid",
    "op6_mix": "mixing",
    "op7_warc": "warc_zip",
    "op8_quality": "quality",
    "op9_token_count": "token_count",
    "op10_bm25": "bm25",
    "op11_spelling": "spelling",
    "op12_transport_stream": "transport_stream",
    "op13_divergence": "divergence",
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return getattr(import_module(f"pagelathe.llm.{_WHERE[name]}"), name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in _WHERE}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"pagelathe.llm.{module}"), "ORACLE", None) for name, module in _WHERE.items()}
    return {name: sql for name, sql in found.items() if sql}
