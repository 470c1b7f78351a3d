"""Every query with SQL gives the rows DuckDB gives on the same tables."""

import duckdb
import pytest

import __spark_entry__ as contract
import checks
from datadict.sources.fixtures import TABLES

QUERIES, ORACLES = checks.QUERIES, checks.ORACLES
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(df.columns) == sorted(names)
    for field in df.schema.fields:
        assert KINDS[field.dataType.simpleString()] == kinds[field.name], field.name
    order = [names.index(c) for c in df.columns]
    want = sorted(repr(tuple(row[i] for i in order)) for row in result.fetchall())
    got = sorted(repr(tuple(row)) for row in df.collect())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_flagship(spark):
    assert contract.entry(spark).count() > 0
