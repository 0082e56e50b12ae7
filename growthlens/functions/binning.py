"""Quantile edges and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantile_edges(value: Column | str, parts: int = 10) -> Column:
    """Aggregate: exact quantiles 0, 1/parts, ..., 1, by linear interpolation."""
    return F.percentile(value, F.array(*(F.lit(i / parts) for i in range(parts + 1))))


def edge_label(value: Column, edges: Column, parts: int = 10) -> Column:
    """Number of the bin a value is in, right ends included; -1 for null.

    Equal edges are one, which keeps the lower number, so empty bins have no rows; the
    outermost bins are open.
    """
    # Only the inner edges part bins: the first edge that repeats stands for all of them.
    inside = F.filter(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: (F.get(edges, i) < value) & ~F.array_contains(F.slice(edges, F.lit(1), i), F.get(edges, i)))
    return F.when(value.isNull(), F.lit(-1)).otherwise(F.coalesce(F.array_max(inside), F.lit(0))).cast("int")


def digitize(value: Column | str, edges: Sequence[float]) -> Column:
    """Number of edges not above a value."""
    value = F.col(value) if isinstance(value, str) else value
    out = F.lit(0)
    for e in edges:
        out = out + (value >= F.lit(float(e))).cast("int")
    return out


def decile_to_quintile(decile: Column | str) -> Column:
    """Quintile of a decile; null for the unknown decile -1."""
    decile = F.col(decile) if isinstance(decile, str) else decile
    return F.when(decile >= 0, F.floor(decile / 2).cast("int"))


def percentile_of_score(value: str, score: Column) -> Column:
    """Aggregate: mean of the percentages of values below a score and of those not above it."""
    v = F.col(value)
    return (F.count_if(v < score) + F.count_if(v <= score) + F.when(F.count_if(v == score) > 0, 1).otherwise(0)) * F.lit(50.0) / F.count(v)
