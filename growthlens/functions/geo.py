"""Geometry as column expressions: lengths, projections, grid arithmetic and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's equatorial radius and flattening (WGS 84), and the radius of the web map projection, in metres.
EQUATOR = 6378137.0
FLATTENING = 1 / 298.257223563
WEB_RADIUS = 6378137.0
#: Pixels a degree, and pixels on a side of a tile.
PER_DEGREE = 120
TILE = 30


def line_length(points: Column) -> Column:
    """Length in metres of an array of (lon, lat) on the ellipsoid; 0 for fewer than two points.

    Lambert's formula: the central angle between reduced latitudes, corrected to the
    first power of the flattening, which is within ten metres over thousands of kilometres.
    """
    n = F.greatest(F.size(points) - 1, F.lit(0))

    def reduced(lat: Column) -> Column:
        return F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))

    # One step after the other, so that each figure of a pair is worked out once.
    pairs = F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), lambda a, b: F.struct(reduced(a["lat"]).alias("a"), reduced(b["lat"]).alias("b"), F.radians(b["lon"] - a["lon"]).alias("turn")))
    angles = F.transform(pairs, lambda x: F.struct(
        (2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.pow(F.sin((x["b"] - x["a"]) / 2), F.lit(2)) + F.cos(x["a"]) * F.cos(x["b"]) * F.pow(F.sin(x["turn"] / 2), F.lit(2)))))).alias("s"),
        F.pow(F.sin((x["a"] + x["b"]) / 2), F.lit(2)).alias("p"), F.pow(F.sin((x["b"] - x["a"]) / 2), F.lit(2)).alias("q")))

    def metres(x: Column) -> Column:
        s, p, q = x["s"], x["p"], x["q"]
        more = F.try_divide((s - F.sin(s)) * p * (1 - q), F.pow(F.cos(s / 2), F.lit(2))) + F.try_divide((s + F.sin(s)) * (1 - p) * q, F.pow(F.sin(s / 2), F.lit(2)))
        return EQUATOR * (s - FLATTENING / 2 * F.coalesce(more, F.lit(0.0)))

    return F.aggregate(F.transform(angles, metres), F.lit(0.0), lambda sum_, d: sum_ + d)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return WEB_RADIUS * F.radians(lon), WEB_RADIUS * F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def pixel(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Row from the north and column from the west."""
    return F.floor((90 - lat) * PER_DEGREE).cast("int"), F.floor((lon + 180) * PER_DEGREE).cast("int")


def pixel_center(row: Column, col: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel's centre."""
    return (col + 0.5) / PER_DEGREE - 180, 90 - (row + 0.5) / PER_DEGREE


def tile(row: Column, col: Column) -> Column:
    """Number of a pixel's tile, row by row from the north-west, from 1."""
    return F.floor(row / TILE).cast("long") * (360 * PER_DEGREE // TILE) + F.floor(col / TILE).cast("long") + 1


def snap(degrees: Column) -> Column:
    return F.round(degrees * PER_DEGREE) / PER_DEGREE


def segment_meets_box(x0: Column, y0: Column, x1: Column, y1: Column, left: Column, low: Column, right: Column, high: Column) -> Column:
    """Does a segment meet a closed box? The parts of it within each pair of sides must overlap."""
    enter, leave = F.lit(0.0), F.lit(1.0)
    fine = F.lit(True)
    for a, b, lo, hi in ((x0, x1, left, right), (y0, y1, low, high)):
        d = b - a
        flat = d == 0
        s, t = F.try_divide(lo - a, d), F.try_divide(hi - a, d)
        enter = F.greatest(enter, F.when(flat, F.lit(0.0)).otherwise(F.least(s, t)))
        leave = F.least(leave, F.when(flat, F.lit(1.0)).otherwise(F.greatest(s, t)))
        fine &= ~flat | ((a >= lo) & (a <= hi))
    return fine & (enter <= leave)


def edges(ring: Column) -> Column:
    """The sides of a closed ring of (x, y), as structs of their ends."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def crossing(y: Column, e: Column) -> Column:
    """Where a side crosses the line at height y; null where it does not."""
    return F.when((e["ay"] > y) != (e["by"] > y), e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)))


def in_polygon(x: Column, y: Column, sides: Column) -> Column:
    """Is a point inside a ring, given by those of its sides that a ray from the point to the east may cross?"""
    return F.size(F.filter(sides, lambda e: F.coalesce(x < crossing(y, e), F.lit(False)))) % 2 == 1


def segments_cross(x0: Column, y0: Column, x1: Column, y1: Column, e: Column) -> Column:
    """Do a segment and a side have a point in common? Neither has both ends strictly on one side of the other."""

    def turn(px: Column, py: Column, qx: Column, qy: Column, x: Column, y: Column) -> Column:
        return (qx - px) * (y - py) - (qy - py) * (x - px)

    ax, ay, bx, by = e["ax"], e["ay"], e["bx"], e["by"]
    boxes = (F.least(x0, x1) <= F.greatest(ax, bx)) & (F.least(ax, bx) <= F.greatest(x0, x1)) & (F.least(y0, y1) <= F.greatest(ay, by)) & (F.least(ay, by) <= F.greatest(y0, y1))
    return boxes & (turn(ax, ay, bx, by, x0, y0) * turn(ax, ay, bx, by, x1, y1) <= 0) & (turn(x0, y0, x1, y1, ax, ay) * turn(x0, y0, x1, y1, bx, by) <= 0)


def boxes_overlap(a: str, b: str) -> Column:
    """Do the interiors of two boxes (left, low, right, high with these prefixes) meet? Touching does not count."""
    c = F.col
    return (c(f"{a}left") < c(f"{b}right")) & (c(f"{b}left") < c(f"{a}right")) & (c(f"{a}low") < c(f"{b}high")) & (c(f"{b}low") < c(f"{a}high"))
