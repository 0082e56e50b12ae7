"""The operators that SQL can express against that SQL."""

import os

import duckdb
import pytest

from growthlens.llm import oracles, queries
from tests.test_queries import rows


@pytest.mark.parametrize("name", oracles.SQL)
def test_oracle(name, spark, data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/{f}'")
    result = con.execute(oracles.SQL[name])
    df = queries.queries()[name](spark, data)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(columns, result.fetchall()) == rows(df.columns, df.collect())
