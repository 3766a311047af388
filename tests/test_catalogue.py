"""Every query of the catalogue with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from tracevale import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in os.listdir(SF):
        c.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{SF}/{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())
