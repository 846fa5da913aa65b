"""Registered queries against their SQL on DuckDB. The slow ones run with FULL=1."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SLOW = ("J8_", "J11", "J26", "E24", "P1_", "P2", "P3", "P4", "P5", "P6", "P9", "P10", "P12", "P13", "P16", "P17", "E37", "E38", "E39", "J24", "E41", "U3", "J28", "J16", "A22", "E29", "A11", "J12", "J13", "J27")
NAMES = [n for n in SQL if os.environ.get("FULL") or not n.startswith(SLOW)]


@pytest.fixture(scope="session")
def con(data):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, data, name):
    assert compare(QUERIES[name](spark, data), con, SQL[name]).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
