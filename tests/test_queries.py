"""Every query with an SQL equivalent against DuckDB."""

import os

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tools.check_queries import normal

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in os.listdir(SMALL):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


@pytest.mark.parametrize("name", ORACLE)
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = db.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    a, b = normal(got), normal(want)
    for column in a.columns:
        assert a[column].astype(str).tolist() == b[column].astype(str).tolist(), column


def test_entry(spark):
    assert entry.entry(spark).count() == 880


def test_texts_name_only_known_queries():
    assert set(ORACLE) <= set(entry.queries())
