"""Joins of points, lines, polygons and rasters by tile.

Whatever covers an area is spread over the square tiles its box touches. An equality
join on the tile finds candidates, an exact predicate decides, and `distinct` folds
those that met in several tiles. Rasters are tables with a row a pixel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.functions import geo as G


def on_tiles(df: DataFrame, left: Column, low: Column, right: Column, high: Column, side: float, names: tuple[str, str] = ("_tx", "_ty")) -> DataFrame:
    """A row for each tile of `side` that a box touches."""
    x, y = names
    out = df.withColumn(x, F.explode(F.sequence(F.floor(left / side), F.floor(right / side))))
    return out.withColumn(y, F.explode(F.sequence(F.floor(low / side), F.floor(high / side))))


def segments_to_boxes(segments: DataFrame, boxes: DataFrame, key: Sequence[str], unit: Sequence[str], side: float) -> DataFrame:
    """Left join of segments (x0, y0, x1, y1) with each box they meet: keys and units, null for a segment in none."""
    c = F.col
    s = on_tiles(segments, F.least("x0", "x1"), F.least("y0", "y1"), F.greatest("x0", "x1"), F.greatest("y0", "y1"), side)
    b = on_tiles(boxes, c("left"), c("low"), c("right"), c("high"), side)
    hit = s.join(b, ["_tx", "_ty"]).where(G.segment_meets_box(c("x0"), c("y0"), c("x1"), c("y1"), c("left"), c("low"), c("right"), c("high"))).select(*key, *unit).distinct()
    return segments.select(*key).distinct().join(hit, list(key), "left")


def _ring_tiles(polygons: DataFrame, unit: str, side: float) -> DataFrame:
    """A row for each tile that a ring's box touches, with the sides that decide whether points of the tile are inside: those at its height, and not to its west."""
    x = [F.transform("ring", lambda p: p[c]) for c in ("x", "y")]
    boxed = polygons.select(unit, G.edges(F.col("ring")).alias("sides"), F.floor(F.array_min(x[0]) / side).alias("_l"), F.floor(F.array_max(x[0]) / side).alias("_r"), F.explode(F.sequence(F.floor(F.array_min(x[1]) / side), F.floor(F.array_max(x[1]) / side))).alias("_ty"))
    low, high = F.col("_ty") * side, (F.col("_ty") + 1) * side
    band = boxed.withColumn("sides", F.filter("sides", lambda e: (F.least(e["ay"], e["by"]) <= high) & (F.greatest(e["ay"], e["by"]) >= low)))
    tiles = band.withColumn("_tx", F.explode(F.sequence("_l", "_r"))).drop("_l", "_r")
    return tiles.withColumn("sides", F.filter("sides", lambda e: F.greatest(e["ax"], e["bx"]) >= F.col("_tx") * side))


def points_to_polygons(points: DataFrame, polygons: DataFrame, key: str, unit: str, side: float) -> DataFrame:
    """Left join of points (x, y) with each polygon (closed `ring`) they are in. Tiles get the sides that matter to them, not whole rings."""
    p = points.withColumn("_tx", F.floor(F.col("x") / side)).withColumn("_ty", F.floor(F.col("y") / side))
    hit = p.join(_ring_tiles(polygons, unit, side), ["_tx", "_ty"]).where(G.in_polygon(F.col("x"), F.col("y"), F.col("sides"))).select(key, unit)
    return points.select(key).join(hit, key, "left")


def segments_to_polygons(segments: DataFrame, polygons: DataFrame, key: str, unit: str, side: float) -> DataFrame:
    """Left join of segments (x0, y0, x1, y1) with each polygon (closed `ring`) they meet: one end is inside, or they cross a side."""
    c = F.col
    within = points_to_polygons(segments.select(key, c("x0").alias("x"), c("y0").alias("y")), polygons, key, unit, side).where(c(unit).isNotNull())
    sides = polygons.select(unit, F.explode(G.edges(c("ring"))).alias("e"))
    e = on_tiles(sides, F.least("e.ax", "e.bx"), F.least("e.ay", "e.by"), F.greatest("e.ax", "e.bx"), F.greatest("e.ay", "e.by"), side)
    s = on_tiles(segments, F.least("x0", "x1"), F.least("y0", "y1"), F.greatest("x0", "x1"), F.greatest("y0", "y1"), side)
    across = s.join(e, ["_tx", "_ty"]).where(G.segments_cross(c("x0"), c("y0"), c("x1"), c("y1"), c("e"))).select(key, unit)
    hit = within.unionByName(across).distinct()
    return segments.select(key).distinct().join(hit, key, "left")


def overlapping_boxes(boxes: DataFrame, key: str, side: float) -> DataFrame:
    """Pairs of different boxes whose interiors meet, each once."""
    c = F.col
    names = ("left", "low", "right", "high")
    tiled = on_tiles(boxes.select(key, *names), c("left"), c("low"), c("right"), c("high"), side)
    a = tiled.select(F.col(key).alias("a"), *(c(n).alias(f"a_{n}") for n in names), "_tx", "_ty")
    b = tiled.select(F.col(key).alias("b"), *(c(n).alias(f"b_{n}") for n in names), "_tx", "_ty")
    return a.join(b, ["_tx", "_ty"]).where(c("a") < c("b")).where(G.boxes_overlap("a_", "b_")).select("a", "b").distinct()


def segment_pixels(segments: DataFrame, key: Sequence[str]) -> DataFrame:
    """The pixels (row, col) that each line's segments, in degrees, meet."""
    c = F.col
    r0, c0 = G.pixel(F.least("x0", "x1"), F.greatest("y0", "y1"))
    r1, c1 = G.pixel(F.greatest("x0", "x1"), F.least("y0", "y1"))
    cells = segments.withColumn("row", F.explode(F.sequence(r0, r1))).withColumn("col", F.explode(F.sequence(c0, c1)))
    d = F.lit(float(G.PER_DEGREE))
    box = (c("col") / d - 180, 90 - (c("row") + 1) / d, (c("col") + 1) / d - 180, 90 - c("row") / d)
    return cells.where(G.segment_meets_box(c("x0"), c("y0"), c("x1"), c("y1"), *box)).select(*key, "row", "col").distinct()


def line_means(segments: DataFrame, raster: DataFrame, key: Sequence[str], band: str, length: str, longest: float) -> DataFrame:
    """Mean of the raster under each line; null for a line of `longest` or more, and where the raster has nothing."""
    short = segments.where(F.col(length) < longest)
    # A line's row becomes many pixels, which no estimate from the lines' files knows of: neither side is broadcast.
    means = segment_pixels(short, key).join(raster.select("row", "col", band).hint("merge"), ["row", "col"]).groupBy(*key).agg(F.avg(band).alias(band))
    return segments.select(*key).distinct().join(means, list(key), "left")


def sample_points(points: DataFrame, raster: DataFrame, key: str, band: str) -> DataFrame:
    """The value under each point (lon, lat); null outside the raster."""
    row, col = G.pixel(F.col("lon"), F.col("lat"))
    return points.select(key, row.alias("row"), col.alias("col")).join(raster.select("row", "col", band), ["row", "col"], "left").select(key, "row", "col", band)


def rasterized(polygons: DataFrame, unit: str) -> DataFrame:
    """The pixels whose centre is in a polygon, with the polygon's unit; the same ring twice counts once.

    Each side gives the places where it crosses the middles of pixel rows; a row's
    crossings in order are where a ring starts and ends. So work goes by the rows of
    sides and not by the pixels of boxes, no row holds a ring, and a large polygon is
    spread over as many tasks as there are rows.
    """
    d = G.PER_DEGREE
    sides = polygons.select(unit, "ring").distinct().select(unit, F.xxhash64("ring").alias("_ring"), F.explode(G.edges(F.col("ring"))).alias("e"))
    top, low = F.greatest("e.ay", "e.by"), F.least("e.ay", "e.by")
    rows = sides.withColumn("row", F.explode(F.sequence(F.floor((90 - top) * d).cast("int"), F.floor((90 - low) * d).cast("int"))))
    _, middle = G.pixel_center(F.col("row"), F.lit(0))
    met = rows.withColumn("x", G.crossing(middle, F.col("e"))).where("x is not null")
    runs = met.groupBy(unit, "_ring", "row").agg(F.sort_array(F.collect_list("x")).alias("x"))
    pairs = runs.select(unit, "row", "x", F.explode(F.sequence(F.lit(0), F.size("x") - 2, F.lit(2))).alias("k")).select(unit, "row", F.get("x", F.col("k")).alias("enter"), F.get("x", F.col("k") + 1).alias("leave"))
    # A pixel more at either end, and then the middles themselves decide.
    cells = pairs.withColumn("col", F.explode(F.sequence(F.floor((F.col("enter") + 180) * d).cast("int") - 1, F.floor((F.col("leave") + 180) * d).cast("int") + 1)))
    lon, _ = G.pixel_center(F.col("row"), F.col("col"))
    return cells.withColumn("_x", lon).where("_x >= enter and _x < leave").select(unit, "row", "col")


def mosaic(rasters: Sequence[DataFrame], bands: Sequence[str]) -> DataFrame:
    """One pixel table of several; where they overlap, the greatest value counts."""
    out = rasters[0]
    for r in rasters[1:]:
        out = out.unionByName(r)
    return out.groupBy("row", "col").agg(*(F.max(b).alias(b) for b in bands))


def on_grid(raster: DataFrame, rows: int, cols: int, bands: Sequence[str], fill: float | None = None) -> DataFrame:
    """Every pixel of a grid that starts at (0, 0), those that are missing with `fill`."""
    spark = raster.sparkSession
    full = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    out = full.join(raster.select("row", "col", *bands), ["row", "col"], "left")
    return out if fill is None else out.na.fill(fill, subset=list(bands))


def zonal(raster: DataFrame, zone: str, band: str, area: str) -> DataFrame:
    """Sum and area-weighted mean of a band by zone. Pixels without a value still count in the area."""
    return raster.where(F.col(zone).isNotNull()).groupBy(zone).agg(F.sum(band).alias("total"), F.try_divide(F.sum(F.col(band) * F.col(area)), F.sum(area)).alias("mean"))


def density(raster: DataFrame, areas: DataFrame, band: str) -> DataFrame:
    """Adds the pixel's area, by its row, and the band over the area."""
    return raster.join(areas, "row").withColumn("density", F.try_divide(F.col(band), F.col("area")))


def masked(raster: DataFrame, zones: DataFrame, keep: Column) -> DataFrame:
    """The pixels whose zones pass."""
    return raster.join(zones.where(keep), ["row", "col"])


def metadata(raster: DataFrame) -> DataFrame:
    """Corner, size, tiles and alignment of a raster, as one row."""
    tiles = G.tile(F.col("row"), F.col("col"))
    out = raster.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count_distinct(tiles).alias("n_tiles"), F.count("*").alias("n_pixels"))
    d = float(G.PER_DEGREE)
    return out.select((F.col("c0") / d - 180).alias("left"), (90 - F.col("r0") / d).alias("top"), (F.col("c1") - F.col("c0") + 1).alias("width"), (F.col("r1") - F.col("r0") + 1).alias("height"), "n_tiles", "n_pixels")
