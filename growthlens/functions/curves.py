"""Growth curves as column expressions, and what they say of completion.

A curve takes x and its parameters as columns. Curves with jumps add a step after
each jump's place; steps placed beyond `last` do not count. Heights are taken without
their sign.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The share of the asymptote at which growth counts as complete.
COMPLETE = 0.99


def line(x: Column, p: Sequence[Column], first: Column, last: Column) -> Column:
    return F.when(x > p[0], (x - p[0]) * p[1]).otherwise(F.lit(0.0))


def logistic(x: Column, middle: Column, rate: Column, height: Column) -> Column:
    return height / (1 + F.exp(-rate * (x - middle)))


def sigmoid(x: Column, p: Sequence[Column], first: Column, last: Column) -> Column:
    return logistic(x, p[0], p[1], p[2])


def sigmoid_with_jumps(x: Column, p: Sequence[Column], first: Column, last: Column) -> Column:
    """Parameters: middle, rate, floor, top, then place and height of each jump."""
    middle, rate, floor, top = p[:4]
    steps, after = F.lit(0.0), F.lit(0.0)
    for place, height in zip(p[4::2], p[5::2], strict=True):
        height = F.when(place > last, F.lit(0.0)).otherwise(F.abs(height))
        steps = steps + height
        after = after + F.when(x > place, height).otherwise(F.lit(0.0))
    return F.abs(floor) + after + logistic(x, middle, rate, top - steps - F.abs(floor))


def sigmoid_with_ramp(x: Column, p: Sequence[Column], first: Column, last: Column) -> Column:
    """Parameters: middle, rate, top, and start, width and height of a ramp: within it the curve is ahead of itself by up to the height, taken without its sign."""
    middle, rate, top, start, width, height = p
    ahead = F.when((x > start) & (x < start + width), F.abs(height) * (x - start) / F.nullif(width, F.lit(0.0))).otherwise(F.lit(0.0))
    return logistic(x + ahead, middle, rate, top)


def gompertz(x: Column, p: Sequence[Column], first: Column, last: Column) -> Column:
    """Parameters: asymptote, displacement, rate on x scaled to [0, 1] between the outer dates."""
    scaled = (x - first) / (last - first)
    return p[0] * F.exp(-p[1] * F.exp(-p[2] * scaled))


def logistic_end(p: Sequence[Column], first: Column, last: Column, share: float = COMPLETE) -> Column:
    return p[0] - F.ln(F.lit(1 / share - 1)) / p[1]


def gompertz_end(p: Sequence[Column], first: Column, last: Column, share: float = COMPLETE) -> Column:
    """On the scale of the data's own range, given here as first and last."""
    return -F.ln(-F.ln(F.lit(share)) / p[1]) / p[2] * (last - first) + first


def no_end(p: Sequence[Column], first: Column, last: Column, share: float = COMPLETE) -> Column:
    return F.lit(None).cast("double")


@dataclass(frozen=True)
class Curve:
    """A curve by name: expression, number of parameters, date of completion, place of the asymptote among the parameters."""

    name: str
    size: int
    value: Callable[[Column, Sequence[Column], Column, Column], Column]
    end: Callable[..., Column]
    top: int | None

    def asymptote(self, p: Sequence[Column]) -> Column:
        return F.lit(None).cast("double") if self.top is None else p[self.top]


CURVES = {
    c.name: c
    for c in (
        Curve("line", 2, line, no_end, None),
        Curve("sigmoid", 3, sigmoid, logistic_end, 2),
        *(Curve(f"sigmoid_{n}_jumps", 4 + 2 * n, sigmoid_with_jumps, logistic_end, 3) for n in (1, 2, 3, 4)),
        Curve("sigmoid_ramp", 6, sigmoid_with_ramp, logistic_end, 2),
        Curve("gompertz", 3, gompertz, gompertz_end, 0),
    )
}


def parameters(array: str, size: int) -> list[Column]:
    return [F.get(F.col(array), F.lit(i)) for i in range(size)]


def mean_square_error(y: Column | str, fitted: Column) -> Column:
    """Aggregate; null where any parameter is."""
    y = F.col(y) if isinstance(y, str) else y
    return F.avg(F.pow(fitted - y, F.lit(2.0)))
