"""Every query against its DuckDB equivalent at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from pagelathe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(value) -> str:
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, list | tuple):
        return f"[{','.join(map(canonical, value))}]"
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted("|".join(canonical(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    expected = sorted("|".join(canonical(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
