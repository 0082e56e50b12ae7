"""Brings the estimates of several methods together and chooses among them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.05


def growth_factor(longest: str, then: str) -> Column:
    """Growth since the sample's date, at least 1."""
    return F.greatest(F.lit(1.0), F.coalesce(F.try_divide(F.col(longest), F.col(then)), F.lit(1.0)))


def scaled_share(share: str, growth: Column) -> Column:
    """A share brought up to date, at most 1, null if too small to be of use."""
    now = F.when(F.col(share).isNotNull(), F.least(F.lit(1.0), F.col(share) * growth))
    return F.when(now >= TOLERANCE, now)


def near(x: str, y: str, tolerance: float) -> Column:
    return F.coalesce(F.abs(F.col(x) - F.col(y)) <= tolerance, F.lit(False))


def agreement(fit: str, model: str, low: str, high: str, sample: str, sample_low: str, sample_high: str, tolerance: float = TOLERANCE) -> Column:
    """The fit agrees with the model (by value or interval) and with the sample (by value or interval)."""
    inside = F.coalesce(F.col(fit).between(F.col(low), F.col(high)), F.lit(False))
    inside_sample = F.coalesce(F.col(fit).between(F.col(sample_low), F.col(sample_high)), F.lit(False))
    return F.coalesce(F.col(fit).isNotNull(), F.lit(False)) & (near(fit, model, tolerance) | inside) & (near(fit, sample, tolerance) | inside_sample)


def choose(fit: str, model: str, low: str, high: str, agree: Column, tolerance: float = TOLERANCE) -> Column:
    """Which estimate to report: the fit if all agree or it lies in the model's interval, else the model if there is one and the fit is not near it, else the fit if there is no model."""
    return (
        F.when(agree, F.lit("fit"))
        .when(F.coalesce(F.col(fit).between(F.col(low) - tolerance, F.col(high) + tolerance), F.lit(False)), F.lit("fit"))
        .when(F.col(model).isNotNull(), F.lit("model"))
        .when(F.col(fit).isNotNull() & F.col(model).isNull(), F.lit("fit"))
    )


def label(x: str, pairs: Sequence[tuple[str, str]]) -> Column:
    out = F.col(x)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def two_decimals(x: Column | str) -> Column:
    """Two decimals, blank for null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNull(), F.lit("")).otherwise(F.format_string("%.2f", x))


def short_count(x: str) -> Column:
    """Millions with M, thousands with k."""
    v = F.col(x)
    return F.when(v >= 1e6, F.concat(F.round(v / 1e6).cast("long").cast("string"), F.lit("M"))).when(v >= 1e3, F.concat(F.round(v / 1e3).cast("long").cast("string"), F.lit("k"))).otherwise(v.cast("long").cast("string"))


def exported(df: DataFrame, names: Mapping[str, str], order: Sequence[str], drop_prefixes: Sequence[str] = (), kilometres: Sequence[str] = ()) -> DataFrame:
    """Columns renamed, metres in whole kilometres, unwanted families left out, in a fixed order and then by name."""
    kept = [c for c in df.columns if not any(c.startswith(p) for p in drop_prefixes)]
    out = df.select(*((F.round(F.col(c) / 1000).cast("long").alias(c) if c in kilometres else F.col(c)) for c in kept)).withColumnsRenamed(dict(names))
    return out.select(*(c for c in order if c in out.columns), *sorted(c for c in out.columns if c not in order))
