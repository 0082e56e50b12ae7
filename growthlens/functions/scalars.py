"""Small column expressions: time axes, logits, rounding, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A time axis of about 1 for present-day dates: seconds since 1970 over this.
EPOCH_SCALE = 1e9


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x: Column | str) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def to_axis(day: Column | str) -> Column:
    return F.unix_date(_c(day).cast("date")) * F.lit(86400.0) / EPOCH_SCALE


def from_axis(x: Column | str, first: str = "2000-01-01", end: str = "2100-01-01") -> Column:
    """The date at a place of the axis; null outside (first, end)."""
    seconds = F.floor(_c(x) * EPOCH_SCALE).cast("long")
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    return F.when((_c(x) > to_axis(F.lit(first))) & (_c(x) < to_axis(F.lit(end))), day)


def decimal_year(day: Column | str) -> Column:
    return F.year(_c(day)) + (F.dayofyear(_c(day)) - 1) / F.lit(366.0)


def invlogit(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def log_share_left(x: Column | str) -> Column:
    """ln(1 - x), null from 1 on."""
    return F.when(_c(x) < 1, F.ln(1 - _c(x)))


def polynomial(x: Column, coefficients: Sequence[Column]) -> Column:
    """Horner's rule; the first coefficient is the constant."""
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def significant(x: Column | str, digits: int) -> Column:
    """Rounded to so many significant digits; zero stays zero."""
    x = _c(x).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


def min_max(x: Column, low: Column, high: Column) -> Column:
    return F.try_divide(x - low, high - low)


def opacity(share: Column, low: float = 1.0, high: float = 3.0, faint: float = 0.2) -> Column:
    """Clips to [low, high] and rescales to [faint, 1]."""
    return faint + (F.least(F.greatest(share, F.lit(low)), F.lit(high)) - low) / (high - low) * (1 - faint)


def recode(x: Column | str, codes: Mapping[str, str]) -> Column:
    out = _c(x)
    for old, new in codes.items():
        out = F.when(_c(x) == old, F.lit(new)).otherwise(out)
    return out


def replace_all(x: Column | str, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    out = _c(x)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def explicit_order(x: Column | str, preferred: Sequence[str]) -> Column:
    """Place in a preferred list, after which all others come; sort by this, then by the value."""
    at = F.array_position(F.array(*(F.lit(p) for p in preferred)), _c(x))
    return F.when(at > 0, at).otherwise(F.lit(len(preferred) + 1))
