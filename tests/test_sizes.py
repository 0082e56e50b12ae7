"""What larger tables had shown."""

import math

import numpy as np
from pyspark.sql import functions as F

from growthlens import catalogue
from growthlens.operators import fitting
from growthlens.plans import curves as curve_plans
from growthlens.plans.base import Tables


def test_pixels_of_lines_are_not_broadcast_by_an_estimate(spark, data):
    """Lines have many pixels each, of which their files say nothing."""
    plan = catalogue.queries()["line_raster_means"](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_fits_have_no_lower_point_beside_them(spark):
    """A place of a jump that a simplex had left on the wrong side of a step."""
    series = curve_plans.cumulative(Tables(spark, "/root/testdata/sf0.1")).where("grp = 'AUTOMOBILE'").withColumn("y", F.col("y") * 1000)
    fit = fitting.fit_curves(series, "grp", "x", "y", *curve_plans._AXIS, curves=["sigmoid_3_jumps"]).collect()[0]
    x, y = (np.array(v, float) for v in zip(*((r["x"], r["y"]) for r in series.collect()), strict=True))
    error = lambda p: np.mean((fitting.evaluate("sigmoid_3_jumps", x, p, *curve_plans._AXIS) - y) ** 2)
    p = np.array(fit["params"])
    assert fit["success"] and math.isclose(error(p), fit["mse"], rel_tol=1e-6)
    for i in range(len(p)):
        for by in (0.99, 1.01):
            assert error(np.where(np.arange(len(p)) == i, p * by, p)) >= 0.98 * fit["mse"]


def test_a_value_of_steps_is_followed_down():
    """Steps of two hundredths, which a simplex at its usual first width passes over."""
    best, value, ok = fitting.least_point(lambda p: 1e4 if not 0.985 < p[0] < 1.002 else 10.0 if p[0] > 0.995 else 1.0, np.array([1.0]))
    assert ok and value == 1.0 and 0.985 < best[0] <= 0.995
