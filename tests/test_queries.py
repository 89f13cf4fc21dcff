"""Every registered query against its DuckDB formulation, on the smallest test tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import oracle
from modlens.plans.queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
ORACLE = oracle.statements()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


def comparable(columns, rows):
    def value(v):
        return f"{v:.6f}" if isinstance(v, float) else "null" if v is None else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(row[i]) for i in order) for row in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    frame = QUERIES[name](spark, str(FOLDER))
    expected = database.sql(ORACLE[name])
    assert sorted(frame.columns) == sorted(expected.columns)
    rows = frame.collect()
    assert rows
    assert comparable(frame.columns, rows) == comparable(expected.columns, expected.fetchall())


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns[0] == "module_id"
    assert frame.count() == 1500
