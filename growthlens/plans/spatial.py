"""Queries on points, lines, polygons and rasters, all derived from keys by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.functions import geo as G
from growthlens.operators import spatial as P
from growthlens.plans.base import Tables, query

_PT = "CAST((c_custkey * 37 % 900) AS DOUBLE) / 100 - 4.4567 AS lon, CAST((c_custkey * 53 % 700) AS DOUBLE) / 100 + 40.1234 AS lat"


def located(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k, "c_nationkey", ((k * 37 % 900).cast("double") / 100 - 4.4567).alias("lon"), ((k * 53 % 700).cast("double") / 100 + 40.1234).alias("lat"))


@query(f"""WITH p AS (SELECT c_custkey, c_nationkey, {_PT} FROM customer), l AS (SELECT c_nationkey, lon, lat, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM p WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
r AS (SELECT c_nationkey, atan((1 - {G.FLATTENING!r}) * tan(radians(plat))) AS a, atan((1 - {G.FLATTENING!r}) * tan(radians(lat))) AS b, radians(lon - plon) AS turn FROM l),
t AS (SELECT c_nationkey, 2 * asin(sqrt(pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(turn / 2), 2))) AS s, pow(sin((a + b) / 2), 2) AS p, pow(sin((b - a) / 2), 2) AS q FROM r)
SELECT c_nationkey, round(coalesce(sum({G.EQUATOR} * (s - {G.FLATTENING / 2!r} * CASE WHEN s > 0 THEN (s - sin(s)) * p * (1 - q) / pow(cos(s / 2), 2) + (s + sin(s)) * (1 - p) * q / pow(sin(s / 2), 2) ELSE 0 END)), 0), 2) AS metres FROM t GROUP BY 1""")
def line_lengths(t: Tables) -> DataFrame:
    """G1, G2."""
    lines = located(t).groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "lon", "lat"))).alias("points"))
    return lines.select("c_nationkey", F.round(G.line_length(F.col("points")), 2).alias("metres"))


@query(f"WITH p AS (SELECT c_custkey, {_PT} FROM customer) SELECT c_custkey, round(6378137.0 * radians(lon), 4) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS y, round(round(lon * 120) / 120, 8) AS snapped FROM p")
def projected(t: Tables) -> DataFrame:
    """E30, G10."""
    x, y = G.web_mercator(F.col("lon"), F.col("lat"))
    return located(t).select("c_custkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(G.snap(F.col("lon")), 8).alias("snapped"))


_RASTER = 'r AS (SELECT CAST(i // 1200 + 5160 AS INT) AS "row", CAST(i % 1200 + 21000 AS INT) AS col, CAST(i * 7919 % 1009 AS DOUBLE) AS pop FROM range(0, 996000) t(i) WHERE i % 11 <> 0)'


def raster(t: Tables) -> DataFrame:
    """Population by pixel over ten degrees by seven, with gaps."""
    i = F.col("id")
    return t.spark.range(996000).where("id % 11 <> 0").select((F.floor(i / 1200) + 5160).cast("int").alias("row"), (i % 1200 + 21000).cast("int").alias("col"), (i * 7919 % 1009).cast("double").alias("pop"))


@query(f"""WITH {_RASTER}, p AS (SELECT c_custkey, CAST(floor((90 - lat) * 120) AS INT) AS "row", CAST(floor((lon + 180) * 120) AS INT) AS col FROM (SELECT c_custkey, {_PT} FROM customer)) SELECT c_custkey, p."row", p.col, pop FROM p LEFT JOIN r ON p."row" = r."row" AND p.col = r.col""")
def raster_at_points(t: Tables) -> DataFrame:
    """By arithmetic and equality."""
    return P.sample_points(located(t), raster(t), "c_custkey", "pop")


@query("SELECT i AS id, CAST(i // 43 AS INT) AS \"row\", round((i % 43 + 0.5) / 120.0 - 180, 8) AS lon, round(90 - (i // 43 + 0.5) / 120.0, 8) AS lat, CAST((i // 43) // 30 * 1440 + (i % 43) // 30 + 1 AS BIGINT) AS tile FROM range(0, 4000) t(i)")
def grid_arithmetic(t: Tables) -> DataFrame:
    """E29, G17."""
    row, col = F.floor(F.col("id") / 43).cast("int"), (F.col("id") % 43).cast("int")
    lon, lat = G.pixel_center(row, col)
    return t.spark.range(4000).select("id", row.alias("row"), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"), G.tile(row, col).alias("tile"))


_AREA = "a AS (SELECT CAST(i AS INT) AS \"row\", CAST(1 + i % 5 AS DOUBLE) AS area FROM range(5000, 6100) t(i))"


def areas(t: Tables) -> DataFrame:
    return t.spark.range(5000, 6100).select(F.col("id").cast("int").alias("row"), (1 + F.col("id") % 5).cast("double").alias("area"))


@query(f'WITH {_RASTER}, {_AREA} SELECT col % 9 AS zone, sum(pop) AS total, round(sum(pop * area) / sum(area), 8) AS mean FROM (SELECT r.col, CASE WHEN r.col % 4 <> 0 THEN pop END AS pop, area FROM r JOIN a ON r."row" = a."row") GROUP BY 1')
def zonal_statistics(t: Tables) -> DataFrame:
    """A22, G9."""
    r = raster(t).withColumn("pop", F.when(F.col("col") % 4 != 0, F.col("pop"))).join(areas(t), "row").withColumn("zone", F.col("col") % 9)
    return P.zonal(r, "zone", "pop", "area").select("zone", "total", F.round("mean", 8).alias("mean"))


@query(f'WITH {_RASTER}, {_AREA} SELECT r."row", CAST(count(*) AS BIGINT) AS n, round(sum(pop / area), 4) AS density FROM r JOIN a ON r."row" = a."row" GROUP BY 1')
def pixel_density(t: Tables) -> DataFrame:
    """Area by row, band over band."""
    return P.density(raster(t), areas(t), "pop").groupBy("row").agg(F.count("*").alias("n"), F.round(F.sum("density"), 4).alias("density"))


@query(f"""WITH {_RASTER}, b AS (SELECT "row", col + 600 AS col, pop + 5 AS pop FROM r WHERE col % 2 = 0), u AS (SELECT "row", col, max(pop) AS pop FROM (SELECT * FROM r UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT "row", CAST(count(*) AS BIGINT) AS n, sum(pop) AS pop, min(col) AS c0, max(col) AS c1 FROM u GROUP BY 1""")
def raster_mosaic(t: Tables) -> DataFrame:
    """A25, J13."""
    r = raster(t)
    shifted = r.where("col % 2 = 0").select("row", (F.col("col") + 600).alias("col"), (F.col("pop") + 5).alias("pop"))
    return P.mosaic([r, shifted], ["pop"]).groupBy("row").agg(F.count("*").alias("n"), F.sum("pop").alias("pop"), F.min("col").alias("c0"), F.max("col").alias("c1"))


@query(f"""WITH {_RASTER}, s AS (SELECT "row" - 5160 AS "row", col - 21000 AS col, pop FROM r WHERE "row" < 5190 AND col < 21040), g AS (SELECT CAST(i // 45 AS INT) AS "row", CAST(i % 45 AS INT) AS col FROM range(0, 32 * 45) t(i))
SELECT g."row", g.col, coalesce(s.pop, -1.0) AS pop FROM g LEFT JOIN s ON g."row" = s."row" AND g.col = s.col""")
def padded_grid(t: Tables) -> DataFrame:
    """Missing pixels filled."""
    s = raster(t).where("row < 5190 and col < 21040").select((F.col("row") - 5160).alias("row"), (F.col("col") - 21000).alias("col"), "pop")
    return P.on_grid(s, 32, 45, ["pop"], fill=-1.0)


@query(f'WITH {_RASTER}, z AS (SELECT "row", col, CAST(("row" + col) % 6 AS INT) AS id0, CAST("row" % 4 AS INT) AS id1 FROM r) SELECT id0, id1, CAST(count(*) AS BIGINT) AS n, sum(pop) AS pop FROM r JOIN z ON r."row" = z."row" AND r.col = z.col WHERE id0 = 2 AND id1 IN (1, 3) GROUP BY 1, 2')
def masked_raster(t: Tables) -> DataFrame:
    """A raster under a mask of units."""
    r = raster(t)
    z = r.select("row", "col", ((F.col("row") + F.col("col")) % 6).cast("int").alias("id0"), (F.col("row") % 4).cast("int").alias("id1"))
    return P.masked(r, z, (F.col("id0") == 2) & F.col("id1").isin(1, 3)).groupBy("id0", "id1").agg(F.count("*").alias("n"), F.sum("pop").alias("pop"))


@query(f"""WITH {_RASTER} SELECT round(min(col) / 120.0 - 180, 8) AS "left", round(90 - min("row") / 120.0, 8) AS top, max(col) - min(col) + 1 AS width, max("row") - min("row") + 1 AS height, count(DISTINCT CAST("row" // 30 * 1440 + col // 30 + 1 AS BIGINT)) AS n_tiles, CAST(count(*) AS BIGINT) AS n_pixels FROM r""")
def raster_metadata(t: Tables) -> DataFrame:
    """G11, G16, IO28, A24."""
    return P.metadata(raster(t)).select(F.round("left", 8).alias("left"), F.round("top", 8).alias("top"), "width", "height", "n_tiles", "n_pixels")


_BOXES = 'b AS (SELECT s_suppkey AS unit, CAST(s_suppkey * 29 % 83 AS DOUBLE) / 10 - 4.47 AS "left", CAST(s_suppkey * 31 % 61 AS DOUBLE) / 10 + 40.13 AS low, CAST(s_suppkey * 29 % 83 AS DOUBLE) / 10 - 4.47 + 0.35 + s_suppkey % 4 * 0.1 AS "right", CAST(s_suppkey * 31 % 61 AS DOUBLE) / 10 + 40.13 + 0.45 AS high FROM supplier)'
_SEGMENTS = "s AS (SELECT c_custkey AS way, lon AS x0, lat AS y0, lon + 0.1 * (c_custkey % 5 - 2) AS x1, lat + 0.07 * (c_custkey % 7 - 3) AS y1 FROM (SELECT c_custkey, " + _PT + " FROM customer))"


def boxes(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 29 % 83).cast("double") / 10 - 4.47, (k * 31 % 61).cast("double") / 10 + 40.13
    return t.supplier.select(k.alias("unit"), x.alias("left"), y.alias("low"), (x + 0.35 + k % 4 * 0.1).alias("right"), (y + 0.45).alias("high"))


def segments(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return located(t).select(k.alias("way"), F.col("lon").alias("x0"), F.col("lat").alias("y0"), (F.col("lon") + 0.1 * (k % 5 - 2)).alias("x1"), (F.col("lat") + 0.07 * (k % 7 - 3)).alias("y1"))


def _meets(left: str, low: str, right: str, high: str) -> str:
    def side(a: str, d: str, lo: str, hi: str) -> tuple[str, str, str]:
        return (f"CASE WHEN {d} = 0 THEN 0.0 ELSE least(({lo} - {a}) / {d}, ({hi} - {a}) / {d}) END", f"CASE WHEN {d} = 0 THEN 1.0 ELSE greatest(({lo} - {a}) / {d}, ({hi} - {a}) / {d}) END", f"({d} <> 0 OR ({a} >= {lo} AND {a} <= {hi}))")

    ax, bx, cx = side("x0", "(x1 - x0)", left, right)
    ay, by, cy = side("y0", "(y1 - y0)", low, high)
    return f"{cx} AND {cy} AND greatest(0.0, {ax}, {ay}) <= least(1.0, {bx}, {by})"


@query(f"""WITH {_BOXES}, {_SEGMENTS}, h AS (SELECT DISTINCT way, unit FROM s JOIN b ON {_meets('"left"', 'low', '"right"', 'high')}) SELECT s.way, h.unit FROM s LEFT JOIN h ON s.way = h.way""")
def lines_in_units(t: Tables) -> DataFrame:
    """Every unit a line meets, or null."""
    return P.segments_to_boxes(segments(t), boxes(t), ["way"], ["unit"], side=0.25)


@query(f"WITH {_BOXES} SELECT p.unit AS a, q.unit AS b FROM b p JOIN b q ON p.unit < q.unit AND p.\"left\" < q.\"right\" AND q.\"left\" < p.\"right\" AND p.low < q.high AND q.low < p.high")
def overlapping_units(t: Tables) -> DataFrame:
    """Units that overlap, touching aside."""
    return P.overlapping_boxes(boxes(t), "unit", side=0.5)


@query(f"""WITH {_RASTER}, {_SEGMENTS}, every AS (SELECT *, abs(x1 - x0) + abs(y1 - y0) AS len FROM s),
c AS (SELECT every.*, CAST(unnest(range(CAST(floor((90 - greatest(y0, y1)) * 120) AS BIGINT), CAST(floor((90 - least(y0, y1)) * 120) AS BIGINT) + 1)) AS INT) AS "row" FROM every WHERE len < 0.3),
d AS (SELECT c.*, CAST(unnest(range(CAST(floor((least(x0, x1) + 180) * 120) AS BIGINT), CAST(floor((greatest(x0, x1) + 180) * 120) AS BIGINT) + 1)) AS INT) AS col FROM c),
h AS (SELECT way, d."row", d.col FROM d WHERE {_meets('(col / 120.0::DOUBLE - 180)', '(90 - ("row" + 1) / 120.0::DOUBLE)', '((col + 1) / 120.0::DOUBLE - 180)', '(90 - "row" / 120.0::DOUBLE)')}),
m AS (SELECT way, avg(pop) AS pop FROM h JOIN r ON h."row" = r."row" AND h.col = r.col GROUP BY 1) SELECT every.way, round(m.pop, 6) AS pop FROM every LEFT JOIN m ON every.way = m.way""")
def line_raster_means(t: Tables) -> DataFrame:
    """The raster under a line, if it is not too long."""
    s = segments(t).withColumn("len", F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0")))
    return P.line_means(s, raster(t), ["way"], "pop", "len", 0.3).select("way", F.round("pop", 6).alias("pop"))


def triangles(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = k * 0.31 - 4.0013, k * 0.17 + 41.0007
    p = [(x, y), (x + 0.6, y + 0.11), (x + 0.2, y + 0.7), (x, y)]
    return t.nation.select(k.alias("unit"), F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in p)).alias("ring"))


_TRI = "t AS (SELECT n_nationkey AS unit, n_nationkey * 0.31 - 4.0013 AS x, n_nationkey * 0.17 + 41.0007 AS y FROM nation)"


def _inside(px: str, py: str) -> str:
    def cross(ax: str, ay: str, bx: str, by: str) -> str:
        return f"({bx} - ({ax})) * ({py} - ({ay})) - ({by} - ({ay})) * ({px} - ({ax}))"

    return f"{cross('t.x', 't.y', 't.x + 0.6', 't.y + 0.11')} > 0 AND {cross('t.x + 0.6', 't.y + 0.11', 't.x + 0.2', 't.y + 0.7')} > 0 AND {cross('t.x + 0.2', 't.y + 0.7', 't.x', 't.y')} > 0"


@query(f"""WITH {_TRI}, p AS (SELECT c_custkey, {_PT} FROM customer), h AS (SELECT p.c_custkey, t.unit FROM p JOIN t ON {_inside('p.lon', 'p.lat')}) SELECT p.c_custkey, h.unit FROM p LEFT JOIN h ON p.c_custkey = h.c_custkey""")
def points_in_polygons(t: Tables) -> DataFrame:
    """G3 for points."""
    points = located(t).select("c_custkey", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return P.points_to_polygons(points, triangles(t), "c_custkey", "unit", side=0.5)


def _crosses(ax: str, ay: str, bx: str, by: str) -> str:
    """Does the segment of a row cross this one?"""

    def side(px: str, py: str, qx: str, qy: str, x: str, y: str) -> str:
        return f"(({qx} - ({px})) * ({y} - ({py})) - ({qy} - ({py})) * ({x} - ({px})))"

    return f"{side(ax, ay, bx, by, 'x0', 'y0')} * {side(ax, ay, bx, by, 'x1', 'y1')} <= 0 AND {side('x0', 'y0', 'x1', 'y1', ax, ay)} * {side('x0', 'y0', 'x1', 'y1', bx, by)} <= 0"


_SIDES = [_crosses(*e) for e in (("t.x", "t.y", "t.x + 0.6", "t.y + 0.11"), ("t.x + 0.6", "t.y + 0.11", "t.x + 0.2", "t.y + 0.7"), ("t.x + 0.2", "t.y + 0.7", "t.x", "t.y"))]


@query(f"""WITH {_TRI}, {_SEGMENTS}, h AS (SELECT s.way, t.unit FROM s JOIN t ON {_inside('s.x0', 's.y0')} OR {' OR '.join(_SIDES)}) SELECT s.way, h.unit FROM s LEFT JOIN h ON s.way = h.way""")
def lines_in_polygons(t: Tables) -> DataFrame:
    """Every unit with a ring of any form that a line meets, or null."""
    return P.segments_to_polygons(segments(t), triangles(t), "way", "unit", side=0.5)


@query(f"""WITH {_TRI}, g AS (SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col, (c + 0.5) / 120.0 - 180 AS px, 90 - (r + 0.5) / 120.0 AS py FROM range(5200, 5881) a(r), range(21100, 22093) b(c))
SELECT t.unit, CAST(count(*) AS BIGINT) AS n, CAST(sum("row") AS BIGINT) AS rows, CAST(sum(col) AS BIGINT) AS cols FROM g JOIN t ON px BETWEEN t.x AND t.x + 0.6 AND py BETWEEN t.y AND t.y + 0.7 AND {_inside('px', 'py')} GROUP BY 1""")
def rasterized_polygons(t: Tables) -> DataFrame:
    """Pixels whose centre is inside."""
    return P.rasterized(triangles(t), "unit").groupBy("unit").agg(F.count("*").alias("n"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


@query(f"WITH p AS (SELECT c_nationkey AS unit, {_PT} FROM customer) SELECT unit, lon >= 0 AS east, CAST(count(*) AS BIGINT) AS n, round(min(lon), 4) AS \"left\", round(max(lon), 4) AS \"right\" FROM p GROUP BY 1, 2")
def hemispheres(t: Tables) -> DataFrame:
    """Parts of a unit east and west of the meridian."""
    parts = located(t).groupBy(F.col("c_nationkey").alias("unit"), (F.col("lon") >= 0).alias("east"))
    return parts.agg(F.count("*").alias("n"), F.round(F.min("lon"), 4).alias("left"), F.round(F.max("lon"), 4).alias("right"))
