"""Queries take whole tables and whole budgets."""

import re

import pytest

from growthlens import catalogue
from growthlens.functions.curves import CURVES
from growthlens.operators import fitting

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def test_no_cuts_by_id():
    """Filters of queries are features of what they compute: none keeps the least ids, or every n-th of a table for all others."""
    for name, sql in SQL.items():
        assert not re.search(r"(custkey|way_id|way|user_id|orderkey|partkey) < \d", sql), name


def test_rows_of_all_ids(spark):
    small = "/root/testdata/sf0.01"
    count = lambda t: spark.read.parquet(f"{small}/{t}.parquet").count()
    assert QUERIES["curve_values"](spark, small).count() == 8 * count("customer")
    assert QUERIES["row_arithmetic"](spark, small).count() == count("lineitem")
    assert QUERIES["standardized"](spark, small).count() == count("part")
    assert QUERIES["line_raster_means"](spark, small).count() == count("customer")


@pytest.mark.parametrize("name", ["fitted_curves", "fitted_choice", "fitted_by_class"])
def test_fits_of_all_curves_at_full_budget(spark, data, monkeypatch, name):
    seen, fit = [], fitting.fit_curves

    def watched(*args, curves=tuple(CURVES), most=20_000, **more):
        seen.append((len(curves), most))
        return fit(*args, curves=curves, most=most, **more)

    monkeypatch.setattr(fitting, "fit_curves", watched)
    QUERIES[name](spark, data)
    assert seen == [(8, 20_000)]


def test_all_chains(spark, data):
    got = QUERIES["sampled_model"](spark, data).groupBy("cid").count().collect()
    assert {r["count"] for r in got} == {10 * 100}  # ten chains, the second half of 1,000 iterations, every fifth
