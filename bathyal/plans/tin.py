"""Queries over Delaunay triangulations and sections through triangles, with SQL oracles where SQL can tell the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from bathyal.operators import mesh, tin
from bathyal.plans.registry import query
from bathyal.sources import views

#: The hull of the soundings by gift wrapping: corners in counter-clockwise order, then its edges.
HULL = """p AS MATERIALIZED (SELECT DISTINCT x, y FROM soundings),
first AS (SELECT arg_min(x, (x, y)) AS x, arg_min(y, (x, y)) AS y FROM p),
w AS (SELECT 0 AS k, x, y, 0.0::DOUBLE AS dx, -1.0::DOUBLE AS dy FROM first
  UNION ALL
  SELECT k + 1, q[3], q[4], q[3] - x, q[4] - y FROM (
    SELECT k, w.x, w.y, min([round((atan2(dx * (p.y - w.y) - dy * (p.x - w.x), dx * (p.x - w.x) + dy * (p.y - w.y)) + 2 * pi()) % (2 * pi()), 10), -((p.x - w.x) ** 2 + (p.y - w.y) ** 2), p.x, p.y]) AS q
    FROM w, p WHERE (p.x <> w.x OR p.y <> w.y) GROUP BY k, w.x, w.y)
  WHERE k < 1 OR (x, y) <> (SELECT (x, y) FROM first)),
h AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM w a JOIN w b ON b.k = a.k + 1)"""

LINE = [(100.3, 40.7), (1500.9, 700.2), (2300.1, 90.4)]
FACES = """s AS (SELECT row AS r, col AS c, (col + .5) * 30 AS x, (row + .5) * 30 AS y, z FROM seabed),
q AS (SELECT a.x AS x0, b.x AS x1, a.y AS y0, d.y AS y1, a.z AS z00, b.z AS z01, d.z AS z10, e.z AS z11 FROM s a JOIN s b ON b.r = a.r AND b.c = a.c + 1
  JOIN s d ON d.r = a.r + 1 AND d.c = a.c JOIN s e ON e.r = a.r + 1 AND e.c = a.c + 1),
f AS (SELECT x0 AS ax, y0 AS ay, z00 AS az, x1 AS bx, y0 AS "by", z01 AS bz, x1 AS cx, y1 AS cy, z11 AS cz FROM q
  UNION ALL SELECT x0, y0, z00, x1, y1, z11, x0, y1, z10 FROM q)"""


@query("soundings", f"""{HULL}
SELECT (SELECT count(*) FROM p) AS vertices, 2 * (SELECT count(*) FROM p) - 2 - (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM h WHERE (x2 - x1) * (p.y - y1) = (y2 - y1) * (p.x - x1))) AS faces,
round((SELECT sum(x1 * y2 - x2 * y1) FROM h) / 2, 3) AS area, 0 AS faults""")
def tin_facts(spark, sf_dir):
    """A triangulation of n points, b of them on the hull, has 2n - 2 - b faces that fill the hull; Delaunay is all that has no fault."""
    v, f = tin.build_tin(views.soundings(spark, sf_dir))
    used = f.select(F.explode(F.array("a", "b", "c")).alias("v")).agg(F.count_distinct("v").alias("vertices"))
    faults = tin.delaunay_faults(v, f).agg(F.count(F.lit(1)).cast("int").alias("faults"))
    flat = v.withColumn("z", F.lit(0.0))
    shape = mesh.face_areas(f, flat).agg(F.count(F.lit(1)).alias("faces"), F.round(F.sum("area"), 3).alias("area"))
    return used.crossJoin(shape).crossJoin(faults)  # each is one row


@query("soundings", f"""{HULL},
c AS (SELECT row, col, (col + .5) * 7.3 AS x, (row + .5) * 7.3 AS y FROM
  (SELECT unnest(range(floor(min(y) / 7.3)::BIGINT, floor(max(y) / 7.3)::BIGINT + 1)) AS row FROM p), (SELECT unnest(range(floor(min(x) / 7.3)::BIGINT, floor(max(x) / 7.3)::BIGINT + 1)) AS col FROM p))
SELECT row, col, round(.25 * x - .5 * y + 3, 5) AS z FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE (x2 - x1) * (c.y - y1) - (y2 - y1) * (c.x - x1) < 0)""")
def tin_plane(spark, sf_dir):
    """Heights on a plane, by triangles: every cell within the hull has the plane's height."""
    points = views.soundings(spark, sf_dir).withColumn("z", 0.25 * F.col("x") - 0.5 * F.col("y") + 3)
    return mesh.rasterize(tin.placed_faces(points), None, 7.3).select("row", "col", F.round("z", 5).alias("z"))


@query()
def tin_limited(spark, sf_dir):
    """Faces, area and volume over zero of the triangles of all points that have no edge over 5."""
    heights = tin.placed_faces(views.pts(spark, sf_dir), max_edge=5.0)
    area = ((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))) / 2
    return heights.agg(F.count(F.lit(1)).alias("faces"), F.round(F.sum(area), 6).alias("area"), F.round(F.sum(area * (F.col("az") + F.col("bz") + F.col("cz")) / 3), 4).alias("volume"))


@query("seabed", f"""l AS (SELECT * FROM (VALUES {', '.join(f'({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})' for k, (a, b) in enumerate(zip(LINE, LINE[1:])))}) t(seq, px, py, qx, qy)),
g AS (SELECT *, sqrt((qx - px) ** 2 + (qy - py) ** 2) AS len FROM l), m AS (SELECT *, coalesce(sum(len) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM g),
{FACES},
e AS (SELECT m.*, f.*, (bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax) AS area FROM m JOIN f ON least(ax, bx, cx) <= greatest(px, qx) AND greatest(ax, bx, cx) >= least(px, qx)
  AND least(ay, "by", cy) <= greatest(py, qy) AND greatest(ay, "by", cy) >= least(py, qy)),
i AS (SELECT *, unnest([[ax, ay, bx, "by"], [bx, "by", cx, cy], [cx, cy, ax, ay]]) AS k FROM e),
j AS (SELECT *, (qx - px) * (k[4] - k[2]) - (qy - py) * (k[3] - k[1]) AS den FROM i),
t AS (SELECT *, ((k[1] - px) * (k[4] - k[2]) - (k[2] - py) * (k[3] - k[1])) / den AS t, ((k[1] - px) * (qy - py) - (k[2] - py) * (qx - px)) / den AS u FROM j WHERE den <> 0
  UNION ALL SELECT *, 0, 0.5 FROM j WHERE k[1] = ax AND k[2] = ay AND k[3] = bx AND k[4] = "by" AND (bx - ax) * (py - ay) - ("by" - ay) * (px - ax) >= 0 AND (cx - bx) * (py - "by") - (cy - "by") * (px - bx) >= 0 AND (ax - cx) * (py - cy) - (ay - cy) * (px - cx) >= 0
  UNION ALL SELECT *, 1, 0.5 FROM j WHERE k[1] = ax AND k[2] = ay AND k[3] = bx AND k[4] = "by" AND (bx - ax) * (qy - ay) - ("by" - ay) * (qx - ax) >= 0 AND (cx - bx) * (qy - "by") - (cy - "by") * (qx - bx) >= 0 AND (ax - cx) * (qy - cy) - (ay - cy) * (qx - cx) >= 0),
o AS (SELECT seq, cum, len, px, py, qx, qy, ax, ay, az, bx, "by", bz, cx, cy, cz, area, min(t) AS t0, max(t) AS t1 FROM t WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 GROUP BY ALL HAVING max(t) > min(t) + 1e-12),
z AS (SELECT seq, cum + len * t AS ch, e0, ((bx - (px + t * (qx - px))) * (cy - (py + t * (qy - py))) - ("by" - (py + t * (qy - py))) * (cx - (px + t * (qx - px)))) / area AS wa,
  ((cx - (px + t * (qx - px))) * (ay - (py + t * (qy - py))) - (cy - (py + t * (qy - py))) * (ax - (px + t * (qx - px)))) / area AS wb, az, bz, cz, t0, t1, cum, len FROM
  (SELECT *, unnest([t0, t1]) AS t, unnest([0, 1]) AS e0 FROM o)),
r AS (SELECT seq, cum + len * t0 AS ch0, cum + len * t1 AS ch1, max(wa * az + wb * bz + (1 - wa - wb) * cz) FILTER (e0 = 0) AS z0, max(wa * az + wb * bz + (1 - wa - wb) * cz) FILTER (e0 = 1) AS z1 FROM z GROUP BY ALL)
SELECT seq, round(ch0, 4) AS ch0, round(z0, 4) AS z0, round(ch1, 4) AS ch1, round(z1, 4) AS z1, EXISTS (SELECT 1 FROM r b WHERE abs(b.ch1 - r.ch0) < 1e-6) AS joined FROM r""")
def tin_section(spark, sf_dir):
    v, f = mesh.grid_mesh(views.seabed(spark, sf_dir), 30.0)
    lines = spark.createDataFrame([(1, k, *p) for k, p in enumerate(LINE)], "line_id int, seq int, x double, y double")
    found = tin.tin_section(v, f, lines, 30.0)
    return found.select("seq", *[F.round(c, 4).alias(c) for c in ("ch0", "z0", "ch1", "z1")], "joined")
