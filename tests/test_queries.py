"""Every query with SQL against DuckDB, and the others for rows."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from growthlens import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, Decimal):
        return ("decimal", str(v))
    return repr(v) if isinstance(v, (float, bool)) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    got = df.collect()
    assert got or name == "overlapping_units"  # ten units need not overlap
    if name in SQL:
        result = duck.execute(SQL[name])
        columns = [d[0] for d in result.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, got) == rows(columns, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
