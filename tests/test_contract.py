"""Queries beside their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import rows

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_equals_its_sql(spark, base, name):
    df = contract.queries()[name](spark, SF_DIR)
    got = rows(df.columns, df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    answer = base.sql(sql)
    assert sorted(df.columns) == sorted(answer.columns)
    assert got == rows(answer.columns, answer.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
