"""Every registered query against its SQL counterpart in another engine."""

import duckdb
import pytest
from conftest import SMALL_DIR

import __spark_entry__ as contract
from navette.plans.queries import QUERIES

TABLES = ["region", "nation", "customer", "supplier", "orders", "lineitem"]


@pytest.fixture(scope="module")
def other_engine():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL_DIR}/{table}.parquet'")
    yield connection
    connection.close()


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    values = [tuple(row[i] for i in order) for row in rows]
    return sorted(columns), sorted(values, key=lambda r: [(v is None, v if v is not None else 0) for v in r])


def test_contract_lists_the_same_queries():
    assert set(QUERIES) <= set(contract.queries()) and set(QUERIES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, other_engine, name):
    found = contract.queries()[name](spark, SMALL_DIR)
    expected = other_engine.sql(contract.oracle_sql()[name])
    assert table_of(found.columns, found.collect()) == table_of(expected.columns, expected.fetchall())


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns[:3] == ["year", "resid_code", "work_code"]
    assert frame.count() > 0
