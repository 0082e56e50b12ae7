"""Fits every curve to every group, and picks the best.

A group's series is small (a row a day), while groups are many: groups are what is
spread over tasks. The minimiser is a Nelder-Mead simplex in numpy.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.functions.curves import CURVES
from growthlens.functions.curves import parameters as params
from growthlens.operators import temporal as T

#: Budget of a fit.
MOST_STEPS = 20_000


def nelder_mead(f, start: np.ndarray, most: int = MOST_STEPS, tolerance: float = 1e-4) -> tuple[np.ndarray, float, bool]:
    """Least point of f near start, its value, and whether the simplex shrank within the budget."""
    n = len(start)
    points = np.tile(np.asarray(start, float), (n + 1, 1))
    for i in range(n):
        points[i + 1, i] = points[i + 1, i] * 1.05 if points[i + 1, i] else 0.00025
    values = np.array([f(p) for p in points])
    calls = n + 1
    for _ in range(most):
        rank = np.argsort(values, kind="stable")
        points, values = points[rank], values[rank]
        if np.abs(points[1:] - points[0]).max() <= tolerance and np.abs(values[1:] - values[0]).max() <= tolerance:
            return points[0], float(values[0]), True
        if calls >= most:
            break
        center = points[:-1].mean(0)

        def at(step: float, c: np.ndarray = center, w: np.ndarray = points[-1]) -> tuple[np.ndarray, float]:
            p = c + step * (c - w)
            return p, f(p)

        p, v = at(1.0)
        calls += 1
        if v < values[0]:
            q, w = at(2.0)
            calls += 1
            p, v = (q, w) if w < v else (p, v)
        elif v >= values[-2]:
            q, w = at(0.5 if v < values[-1] else -0.5)
            calls += 1
            if w < min(v, values[-1]):
                p, v = q, w
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(x) for x in points[1:]]
                calls += n
                continue
        points[-1], values[-1] = p, v
    return points[0], float(values[0]), False


def least_point(f, start: np.ndarray, most: int = MOST_STEPS, floor: float = 0.0) -> tuple[np.ndarray, float, bool]:
    """As nelder_mead, which starts again while a hundredth more or less of one parameter lowers the value by a hundredth or more.

    Where places of jumps pass points, the value has steps, on which a simplex shrinks far
    from a least point. Each start has the whole budget, the last one tells whether it
    sufficed. Values up to `floor` are as good as none.
    """
    point, value, ok = nelder_mead(f, start, most)
    while value > floor:
        near = [np.where(np.arange(len(point)) == i, point * by, point) for i in range(len(point)) for by in (0.99, 1.01)]
        values = [f(p) for p in near]
        at = int(np.argmin(values))
        if values[at] > 0.99 * value:
            break
        point, value, ok = nelder_mead(f, near[at], most)
    return point, value, ok


def _logistic(x: np.ndarray, m: float, k: float, h: float) -> np.ndarray:
    return h / (1 + np.exp(np.clip(-k * (x - m), -700, 700)))


def evaluate(name: str, x: np.ndarray, p: Sequence[float], first: float, last: float) -> np.ndarray:
    """A curve in numpy; the tests hold it against the column expression."""
    if name == "line":
        return np.where(x > p[0], (x - p[0]) * p[1], 0.0)
    if name == "sigmoid":
        return _logistic(x, *p)
    if name == "gompertz":
        return p[0] * np.exp(-p[1] * np.exp(np.clip(-p[2] * (x - first) / (last - first), -700, 700)))
    if name == "sigmoid_ramp":
        m, k, top, start, width, height = p
        ahead = (x - start) * (abs(height) / width) if width > 0 else 0.0
        return _logistic(x + np.where((x > start) & (x < start + width), ahead, 0.0), m, k, top)
    place, height = np.array(p[4::2]), np.abs(np.array(p[5::2]))
    height = np.where(place > last, 0.0, height)
    return abs(p[2]) + (x[:, None] > place) @ height + _logistic(x, p[0], p[1], p[3] - height.sum() - abs(p[2]))


def rise_starts(x: np.ndarray, y: np.ndarray, count: int) -> list[tuple[float, float]] | None:
    """Place and height of the steepest rises of different steep runs; the last one stands in for those that lack. None if few rises are positive."""
    dy = np.diff(y)
    if (dy > 0).sum() < max(4, count + 2):
        return None
    steep = dy >= dy.mean()
    open_, found = steep.copy(), []
    while len(found) < count and open_.any():
        at = int(np.argmax(np.where(open_, dy, -np.inf)))
        found.append((float(x[at]), float(dy[at])))
        lo = hi = at
        while lo > 0 and steep[lo - 1]:
            lo -= 1
        while hi + 1 < len(dy) and steep[hi + 1]:
            hi += 1
        open_[lo : hi + 1] = False
    return found + [found[-1]] * (count - len(found))


def start_point(name: str, x: np.ndarray, y: np.ndarray) -> list[float] | None:
    width = max(float(x.max() - x.min()), 1e-12)
    middle, top = float((x.max() + x.min()) / 2), float(y.max())
    if name == "line":
        return [0.0, 0.0]
    if name == "sigmoid":
        return [middle, 10 / width, top]
    if name == "gompertz":
        return [top, 10.0, 6.0]
    if name == "sigmoid_ramp":
        return [float(x.min()), 0.0, top, float(x.mean()), 0.01, 0.01]
    rises = rise_starts(x, y, (CURVES[name].size - 4) // 2)
    return None if rises is None else [middle, 10 / width, float(y.min()), top, *(v for r in rises for v in r)]


def fit_curves(series: DataFrame, group: str, x: str, y: str, first: float, last: float, curves: Sequence[str] = tuple(CURVES), least: int = 10, most: int = MOST_STEPS) -> DataFrame:
    """Long table of fits: group, curve, params, mse, success, asymptote, end_x.

    Groups of fewer than `least` points are left out; a curve that has no start has null
    parameters. One row a group and curve is a task's unit of work.
    """
    work = series.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    pairs = work.withColumn("curve", F.explode(F.array(*(F.lit(c) for c in curves))))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < least:
            return pd.DataFrame(columns=[group, "curve", "params", "mse", "success"], dtype=object)
        rows = rows.sort_values(["x", "y"])
        xs, ys, name = rows["x"].to_numpy(), rows["y"].to_numpy(), key[1]
        start = start_point(name, xs, ys)
        if start is None:
            return pd.DataFrame({group: [key[0]], "curve": [name], "params": [None], "mse": [None], "success": [False]})

        def loss(p: np.ndarray) -> float:
            with np.errstate(all="ignore"):
                e = float(np.mean((evaluate(name, xs, p, first, last) - ys) ** 2))
            return e if np.isfinite(e) else 1e300

        best, error, ok = least_point(loss, np.array(start), most, 1e-12 * float(np.mean(ys**2)))
        return pd.DataFrame({group: [key[0]], "curve": [name], "params": [best.tolist()], "mse": [error], "success": [ok]})

    kind = series.schema[group].dataType.simpleString()
    # Few bytes and much work: a number given here is not coalesced.
    spread = pairs.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, "curve")
    fitted = spread.groupBy(group, "curve").applyInPandas(fit, f"{group} {kind}, curve string, params array<double>, mse double, success boolean")
    spans = work.groupBy(group).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    return fitted.join(spans, group).withColumn("asymptote", by_curve(lambda c, p: c.asymptote(p))).withColumn("end_x", by_curve(lambda c, p: c.end(p, F.col("_lo"), F.col("_hi")))).drop("_lo", "_hi")


def by_curve(f, column: str = "curve", array: str = "params") -> Column:
    """The expression of the curve that each row names."""
    return reduce(lambda out, c: out.when(F.col(column) == c.name, f(c, params(array, c.size))), list(CURVES.values())[1:], F.when(F.col(column) == "line", f(CURVES["line"], params(array, 2))))


def best_fit(fits: DataFrame, groups: Sequence[str], error: str = "mse", ordinal: str = "ordinal", without: Sequence[str] = ()) -> DataFrame:
    """The row of least error of each group, the first by ordinal of equals; groups without an error keep their keys alone."""
    usable = fits.where(F.col(error).isNotNull() & ~F.col("curve").isin(list(without)))
    best = T.best_row(usable, groups, [F.col(error).asc(), F.col(ordinal).asc()])
    return fits.select(*groups).distinct().join(best, list(groups), "left")


def fit_summary(best: DataFrame, series: DataFrame, group: str, x: str, y: str, first: float, last: float) -> DataFrame:
    """Completeness by the chosen curve: now, against ten times the last date, and against the asymptote."""
    now = series.groupBy(group).agg(F.max(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("_n")).select(group, F.col("_n.x").alias("x_now"), F.col("_n.y").alias("y_now"))
    joined = best.join(now, group)
    a, b = F.lit(first), F.lit(last)
    at_now = by_curve(lambda c, p: c.value(F.col("x_now"), p, a, b))
    at_far = by_curve(lambda c, p: c.value(F.col("x_now") * 10, p, a, b))
    return joined.withColumn("model_now", at_now).withColumn("share_model", F.try_divide(at_now, at_far)).withColumn("share_fit", F.try_divide(F.col("y_now"), F.col("asymptote")))
