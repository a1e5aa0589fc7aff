"""Queries over sections, comparison in regions, camera geometry and features, each with its SQL oracle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bathyal.operators import cameras, contours, grid, sections
from bathyal.operators.graph import passing_folder, saved
from bathyal.plans.exchange import _features
from bathyal.plans.registry import query
from bathyal.plans.survey import CONCAVE, LINE, _crossings, _segments_sql
from bathyal.sinks import writers
from bathyal.sources import vector, views


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- sections and regions -----------------------------------------------------------------------------------------------

TOTAL = sum(math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(LINE, LINE[1:]))
PLACES = max(2, math.ceil(TOTAL / 5.0) + 1)
DEM = "d AS MATERIALIZED (SELECT floor(y / 4)::BIGINT AS row, floor(x / 12)::BIGINT AS col, round(avg(z), 4) AS z FROM pts GROUP BY ALL)"


@query("pts", f"""d AS (SELECT floor(y / 12)::BIGINT AS row, floor(x / 12)::BIGINT AS col, round(avg(z), 4) AS z FROM pts GROUP BY ALL),
p AS (SELECT k, k * {TOTAL!r}::DOUBLE / {PLACES - 1} AS ch FROM range({PLACES}) t(k)),
s AS (SELECT p.*, arg_max(x1 + (ch - cum) * ux, cum) AS x, arg_max(y1 + (ch - cum) * uy, cum) AS y FROM p JOIN {_segments_sql()} ON ch >= cum GROUP BY ALL),
b AS (SELECT *, floor(x / 12 - .5)::BIGINT AS c0, floor(y / 12 - .5)::BIGINT AS r0, x / 12 - .5 - floor(x / 12 - .5) AS fx, y / 12 - .5 - floor(y / 12 - .5) AS fy FROM s),
k AS (SELECT b.k, ch, (CASE dc WHEN 0 THEN 1 - fx ELSE fx END) * (CASE dr WHEN 0 THEN 1 - fy ELSE fy END) AS w, d.z FROM b, range(0, 2) t(dr), range(0, 2) u(dc), d WHERE d.row = r0 + dr AND d.col = c0 + dc)
SELECT round(ch, 6) AS ch, round(sum(w * z) / sum(w), 5) AS z FROM k GROUP BY k, ch HAVING count(*) = 4""")
def dem_section(spark, sf_dir):
    d = grid.build_dem(views.pts(spark, sf_dir), 12.0, "mean").withColumn("z", F.round("z", 4))
    found = sections.dem_section(d, 12.0, LINE, 5.0).where("z is not null")
    return found.select(F.round("ch", 6).alias("ch"), F.round("z", 5).alias("z"))


def _compared(region: str, n: str) -> str:
    return f"""a AS (SELECT floor(y / 6)::BIGINT AS row, floor(x / 6)::BIGINT AS col, max(z) AS z FROM pts GROUP BY ALL), {region},
j AS (SELECT z - 90 AS d FROM a SEMI JOIN g USING (row, col))
SELECT count(*) AS cells, round(coalesce(sum(d) FILTER (d > 0), 0) * 36, 4) AS fill_volume, (count(*) FILTER (d > 0) * 36)::DOUBLE AS fill_area, round(coalesce(sum(-d) FILTER (d < 0), 0) * 36, 4) AS cut_volume,
(count(*) FILTER (d < 0) * 36)::DOUBLE AS cut_area, round(coalesce(sum(d), 0) * 36, 4) AS net_volume, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(min(d), 6) AS min, round(max(d), 6) AS max,
round(quantile_cont(d, .05), 6) AS p05, round(quantile_cont(d, .95), 6) AS p95, (count(*) * 36)::DOUBLE AS area, ({n} * 36)::DOUBLE AS region_area, round(count(*) / {n}, 6) AS coverage FROM j"""


def _region(inside: str, x1: float, y1: float, x2: float, y2: float) -> str:
    cells = f"range({math.floor(y1 / 6)}, {math.floor(y2 / 6) + 1}) t(row), range({math.floor(x1 / 6)}, {math.floor(x2 / 6) + 1}) u(col)"
    return f"g AS (SELECT row, col FROM (SELECT row, col, (col + .5) * 6 AS x, (row + .5) * 6 AS y FROM {cells}) WHERE {inside})"


def _compare(spark, sf_dir: str, region: DataFrame | None) -> DataFrame:
    a = grid.build_dem(views.pts(spark, sf_dir), 6.0, "max")
    found = sections.compare(a, 90.0, 6.0, region)
    return found.select(*[F.round(c, 4 if c.endswith("volume") else 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


XS, YS = [p[0] for p in CONCAVE], [p[1] for p in CONCAVE]


@query("pts", _compared(_region(_crossings(CONCAVE), min(XS), min(YS), max(XS), max(YS)), "(SELECT count(*) FROM g)"))
def compare_in_polygon(spark, sf_dir):
    return _compare(spark, sf_dir, sections.polygon_cells(spark, 6.0, CONCAVE))


def _corridor() -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(LINE, LINE[1:]):
        n = math.hypot(x2 - x1, y2 - y1)
        ux, uy = (x2 - x1) / n, (y2 - y1) / n
        t = f"greatest(0, least({n!r}::DOUBLE, (x - {x1}) * {ux!r}::DOUBLE + (y - {y1}) * {uy!r}::DOUBLE))"
        parts.append(f"sqrt((x - {x1} - {t} * {ux!r}::DOUBLE) ** 2 + (y - {y1} - {t} * {uy!r}::DOUBLE) ** 2)")
    return f"least({', '.join(parts)}) <= 10"


LX, LY = [p[0] for p in LINE], [p[1] for p in LINE]


@query("pts", _compared(_region(_corridor(), min(LX) - 10, min(LY) - 10, max(LX) + 10, max(LY) + 10), "(SELECT count(*) FROM g)"))
def compare_in_corridor(spark, sf_dir):
    return _compare(spark, sf_dir, sections.corridor_cells(spark, 6.0, LINE, 10.0))


@query("pts", _compared("""b AS (SELECT min(row) - 1 AS r1, max(row) + 1 AS r2, min(col) - 1 AS c1, max(col) + 1 AS c2 FROM a),
e AS (SELECT r AS row, q AS col FROM b, range(r1, r2 + 1) t(r), range(c1, c2 + 1) u(q) EXCEPT SELECT row, col FROM a),
x AS (SELECT r1 AS row, c1 AS col FROM b UNION SELECT e.row, e.col FROM x JOIN e ON abs(e.row - x.row) + abs(e.col - x.col) = 1),
g AS (SELECT row, col FROM a UNION (SELECT row, col FROM e EXCEPT SELECT row, col FROM x))""", "(SELECT count(*) FROM g)"))
def compare_with_holes(spark, sf_dir):
    """Holes inside the surveyed area belong to the region, gaps that are open to the outside don't."""
    return _compare(spark, sf_dir, None)


# ---- cameras ------------------------------------------------------------------------------------------------------------

def _place() -> cameras.Vector:
    return F.col("x"), F.col("y"), F.col("z")


def _named(values, digits: int = 6) -> list:
    return [F.round(v, digits).alias(n) for v, n in zip(values, ("x", "y", "z"))]


@query("vec3", """a AS (SELECT *, sqrt(.3 * .3 + .2 * .2 + .9 * .9) AS t FROM vec3), v AS (SELECT *, .3 / t AS vx, -.2 / t AS vy, .9 / t AS vz FROM a), d AS (SELECT *, (x * vx + y * vy + z * vz) * (1 - cos(t)) AS k FROM v)
SELECT point_id, round(cos(t) * x + sin(t) * (vy * z - vz * y) + k * vx, 6) AS x, round(cos(t) * y + sin(t) * (vz * x - vx * z) + k * vy, 6) AS y, round(cos(t) * z + sin(t) * (vx * y - vy * x) + k * vz, 6) AS z FROM d""")
def axis_rotation(spark, sf_dir):
    turn = tuple(F.lit(v) for v in (0.3, -0.2, 0.9))
    return views.vec3(spark, sf_dir).select("point_id", *_named(cameras.rotate(_place(), turn)))


MATRIX, SHIFT = ((0.8, -0.6, 0.0), (0.6, 0.8, 0.0), (0.0, 0.0, 1.0)), (10.0, -5.0, 2.0)


@query("vec3", "SELECT point_id, round(2.5 * (.8 * x - .6 * y) + 10, 6) AS x, round(2.5 * (.6 * x + .8 * y) - 5, 6) AS y, round(2.5 * z + 2, 6) AS z FROM vec3")
def similarity_applied(spark, sf_dir):
    return views.vec3(spark, sf_dir).select("point_id", *_named(cameras.transformed(_place(), MATRIX, SHIFT, 2.5)))


@query("vec3", """c AS (SELECT point_id, x, y, z + .1 AS d FROM vec3 WHERE z + .1 > .05), n AS (SELECT *, x / d AS a, y / d AS b, (x / d) ** 2 + (y / d) ** 2 AS r2 FROM c)
SELECT point_id, round(1200 * (1 + .05 * r2 - .01 * r2 * r2) * a + 640, 4) AS u, round(1200 * (1 + .05 * r2 - .01 * r2 * r2) * b + 480, 4) AS v, round(d, 6) AS depth FROM n""")
def projected_points(spark, sf_dir):
    u, v, d = cameras.pixel((F.col("x"), F.col("y"), F.col("z") + 0.1), 1200.0, 640.0, 480.0, 0.05, -0.01)
    return views.vec3(spark, sf_dir).where("z + 0.1 > 0.05").select("point_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"), F.round(d, 6).alias("depth"))


@query("vec3", "SELECT point_id, round(x * .5, 5) AS a, round(y * .5, 5) AS b FROM vec3")
def undistorted_pixels(spark, sf_dir):
    """A pixel's direction is what it was before distortion."""
    u, v, _ = cameras.pixel((F.col("x") * 0.5, F.col("y") * 0.5, F.lit(1.0)), 1200.0, 640.0, 480.0, 0.05, -0.01)
    rows = views.vec3(spark, sf_dir).select("point_id", u.alias("u"), v.alias("v"))
    a, b = cameras.undistorted(F.col("u"), F.col("v"), 1200.0, 640.0, 480.0, 0.05, -0.01)
    return rows.select("point_id", F.round(a, 5).alias("a"), F.round(b, 5).alias("b"))


@query("vec3", """d AS (SELECT point_id, x - 1 AS ax, y AS ay, z AS az, x AS bx, y - 1 AS byy, z - 2 AS bz FROM vec3)
SELECT point_id, round(degrees(acos(greatest(-1, least(1, (ax * bx + ay * byy + az * bz) / (sqrt(ax * ax + ay * ay + az * az) * sqrt(bx * bx + byy * byy + bz * bz)))))), 5) AS angle FROM d""")
def view_angles(spark, sf_dir):
    a, b = tuple(F.lit(v) for v in (1.0, 0.0, 0.0)), tuple(F.lit(v) for v in (0.0, 1.0, 2.0))
    return views.vec3(spark, sf_dir).select("point_id", F.round(cameras.view_angle(_place(), a, b), 5).alias("angle"))


@query("vec3", "SELECT point_id, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM vec3")
def triangulated_points(spark, sf_dir):
    """Rays from two centres to a place meet there."""
    a, b = tuple(F.lit(v) for v in (5.0, 0.0, 0.0)), tuple(F.lit(v) for v in (0.0, 5.0, 2.0))
    u, v = tuple((p - c) * 0.3 for p, c in zip(_place(), a)), tuple((p - c) * 2.0 for p, c in zip(_place(), b))
    return views.vec3(spark, sf_dir).select("point_id", *_named(cameras.nearest_to_rays(a, u, b, v), 5))


# ---- features -----------------------------------------------------------------------------------------------------------


@query("structures", "SELECT name AS label, 5 AS vertices FROM structures")
def feature_polygons(spark, sf_dir):
    return vector.polygons(_features(spark, sf_dir)).select("label", F.size("ring").alias("vertices"))


@query("route_vertex", "SELECT 'r' || route_id AS label, count(*)::INT AS vertices FROM route_vertex GROUP BY route_id HAVING count(*) >= 10")
def feature_lines(spark, sf_dir):
    return vector.lines(_features(spark, sf_dir)).select("label", F.size("line").alias("vertices"))


@query("structures", "SELECT min(diameter) AS z1, max(diameter) AS z2 FROM structures")
def feature_heights(spark, sf_dir):
    return vector.z_range(_features(spark, sf_dir))


@query("structures", "SELECT 'name' AS name")
def feature_fields(spark, sf_dir):
    return vector.attribute_fields(_features(spark, sf_dir))


@query("structures", "SELECT name AS label, round(x / 1000 + 121, 6) AS x, round(y / 100 + 25, 6) AS y FROM structures")
def features_reprojected(spark, sf_dir):
    """To a UTM zone and back."""
    s = views.structures(spark, sf_dir)
    place = F.struct((F.col("x") / 1000 + 121).alias("x"), (F.col("y") / 100 + 25).alias("y"), F.lit(None).cast("double").alias("z"))
    f = s.select(F.lit("Point").alias("type"), F.array(F.array(place)).alias("parts"), F.create_map(F.lit("name"), F.col("name")).alias("attrs"))
    there = saved(vector.reproject(f, 4326, 32651))
    back = vector.labelled(vector.reproject(there, 32651, 4326))
    p = F.col("parts")[0][0]
    return back.select("label", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


@query("seabed", """s AS (SELECT a.row, a.col FROM seabed a JOIN seabed b ON b.row = a.row AND b.col = a.col + 1 JOIN seabed c ON c.row = a.row + 1 AND c.col = a.col JOIN seabed d ON d.row = a.row + 1 AND d.col = a.col + 1)
SELECT (SELECT count(*) FROM seabed) AS points, (SELECT 2 * count(*) FROM s) AS faces, (SELECT count(*) FROM seabed) AS largest""")
def landxml_surface(spark, sf_dir):
    """Points and faces of a LandXML surface, and the largest point number that a face names."""
    from bathyal.operators import mesh

    v, f = mesh.grid_mesh(views.seabed(spark, sf_dir), 30.0)
    path = passing_folder(spark, "exchange")
    writers.write_landxml(v, f, path)
    lines = spark.read.text([f"{path}/1-points", f"{path}/3-faces"])
    ids = F.regexp_extract("value", r'<P id="(\d+)"', 1).try_cast("long")
    return lines.agg(F.count_if(F.col("value").contains("<P id")).alias("points"), F.count_if(F.col("value").contains("<F>")).alias("faces"), F.max(ids).alias("largest"))


# ---- contours -----------------------------------------------------------------------------------------------------------


def _cuts(cells: str, levels: str) -> str:
    """l: each level that cuts each square, and how many segments it makes there (a level that meets a corner makes one of no length)."""
    return f"""s AS (SELECT a.row, a.col, a.z AS a, b.z AS b, c.z AS c, e.z AS d FROM {cells} a JOIN {cells} b ON b.row = a.row AND b.col = a.col + 1 JOIN {cells} c ON c.row = a.row + 1 AND c.col = a.col + 1 JOIN {cells} e ON e.row = a.row + 1 AND e.col = a.col),
v AS ({levels}), l AS (SELECT level, (((a >= level) <> (b >= level))::INT + ((b >= level) <> (c >= level))::INT + ((c >= level) <> (d >= level))::INT + ((d >= level) <> (a >= level))::INT) // 2 AS n
FROM s, v WHERE level > least(a, b, c, d) AND level <= greatest(a, b, c, d))"""


WIDE = "d AS MATERIALIZED (SELECT floor(y / 30)::BIGINT AS row, floor(x / 30)::BIGINT AS col, avg(z) AS z FROM pts GROUP BY ALL)"


# Heights are taken to 1e-9, so that a mean which is a level is one whatever the order of its sum; a level that only meets a corner
# has both ends of its segment there, which is no part of a line.
@query("pts", """d AS MATERIALIZED (SELECT floor(y / 30)::BIGINT AS row, floor(x / 30)::BIGINT AS col, round(avg(z), 9) AS z FROM pts GROUP BY ALL),
s AS (SELECT (a.col + .5) * 30 AS x, (a.row + .5) * 30 AS y, a.z AS a, b.z AS b, c.z AS c, e.z AS d FROM d a JOIN d b ON b.row = a.row AND b.col = a.col + 1 JOIN d c ON c.row = a.row + 1 AND c.col = a.col + 1 JOIN d e ON e.row = a.row + 1 AND e.col = a.col),
v AS (SELECT k * 10.0::DOUBLE + 3 AS level FROM range(-100, 100) t(k)),
l AS (SELECT level, (a >= level) = ((a + b + c + d) / 4 >= level) AS joined,
  CASE WHEN (a >= level) <> (b >= level) THEN [round(x + (level - a) / (b - a) * 30, 6), round(y, 6)] END AS s, CASE WHEN (b >= level) <> (c >= level) THEN [round(x + 30, 6), round(y + (level - b) / (c - b) * 30, 6)] END AS e,
  CASE WHEN (c >= level) <> (d >= level) THEN [round(x + (1 - (level - c) / (d - c)) * 30, 6), round(y + 30, 6)] END AS n, CASE WHEN (d >= level) <> (a >= level) THEN [round(x, 6), round(y + (1 - (level - d) / (a - d)) * 30, 6)] END AS w
  FROM s, v WHERE level > least(a, b, c, d) AND level <= greatest(a, b, c, d)),
p AS (SELECT level, list_filter([s, e, n, w], lambda q: q IS NOT NULL) AS p, joined, s, e, n, w FROM l),
g AS (SELECT level, CASE WHEN len(p) = 2 THEN (p[1] <> p[2])::INT WHEN joined THEN (s <> e)::INT + (n <> w)::INT ELSE (s <> w)::INT + (e <> n)::INT END AS n FROM p)
SELECT level, CASE WHEN abs(level) < 1e-9 THEN 'zero' WHEN ((level - 3) / 10)::BIGINT % 5 = 0 THEN 'major' ELSE 'minor' END AS kind, sum(n)::BIGINT AS segments FROM g GROUP BY level HAVING sum(n) > 0""")
def contour_set(spark, sf_dir):
    """Segments of all lines of a level, whichever way they were chained."""
    d = grid.build_dem(views.pts(spark, sf_dir), 30.0, "mean")
    d = saved(d.withColumn("z", F.round("z", 9)))
    lines = contours.make_contours(d, 30.0, 10.0, 3.0)
    return lines.groupBy("level", "kind").agg(F.sum(F.size("points") - 1).alias("segments"))


@query("seabed", f"""b AS MATERIALIZED (SELECT a.row, a.col, max(o.z) AS z FROM seabed a JOIN seabed o ON abs(a.row - o.row) <= 1 AND abs(a.col - o.col) <= 1 GROUP BY ALL),
{_cuts('b', 'SELECT -t.k::DOUBLE AS level FROM (VALUES (0), (2), (5), (10), (15), (20), (25), (30), (40), (50), (100), (200), (500), (1000)) t(k) WHERE t.k > (SELECT min(-z) FROM b) AND t.k < (SELECT max(-z) FROM b)')}
SELECT -level AS depth, sum(n)::BIGINT AS segments FROM l GROUP BY level""")
def depth_contours(spark, sf_dir):
    lines = contours.depth_contours(views.seabed(spark, sf_dir), 30.0)
    return lines.groupBy("depth").agg(F.sum(F.size("points") - 1).alias("segments"))


@query("pts", f"""{WIDE}, n AS (SELECT a.row, a.col, b.z, exp(-((a.row - b.row) ** 2 + (a.col - b.col) ** 2) / 2.0) AS w FROM d a JOIN d b ON abs(a.row - b.row) <= 4 AND abs(a.col - b.col) <= 4)
SELECT row, col, round(sum(w * z) / sum(w), 6) AS z FROM n GROUP BY row, col""")
def smoothed_surface(spark, sf_dir):
    return _rounded(contours.smoothed(grid.build_dem(views.pts(spark, sf_dir), 30.0, "mean"), 1.0))
