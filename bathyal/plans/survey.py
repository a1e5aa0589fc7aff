"""Queries over points, grids, surfaces and hydrographic checks, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bathyal.functions.expressions import round6
from bathyal.operators import grid, ground, hydrography, knn, noise, points, surfaces
from bathyal.plans.registry import query
from bathyal.sources import views

SQUARE = [(100.0, 3.0), (400.0, 3.0), (400.0, 9.0), (100.0, 9.0)]
CONCAVE = [(50.0, 1.0), (600.0, 1.0), (600.0, 12.0), (300.0, 5.5), (50.0, 12.0)]
LINE = [(50.5, 2.25), (300.5, 8.25), (600.5, 4.25)]
CELL = 8.0
AREA = 30.0 * 50.0

PTS_CELLS = "SELECT *, floor(x / 8)::BIGINT AS col, floor(y / 8)::BIGINT AS row FROM pts"


# ---- gridding ---------------------------------------------------------------------------------------------------------


def _dem(method: str):
    def run(spark, sf_dir: str) -> DataFrame:
        return _rounded(grid.build_dem(views.pts(spark, sf_dir), CELL, method), 9)

    run.__name__ = f"grid_{method}"
    sql = {"mean": "avg(z)", "min": "min(z)", "max": "max(z)", "count": "count(z)::DOUBLE"}[method]
    return query("pts", f"SELECT floor(y / 8)::BIGINT AS row, floor(x / 8)::BIGINT AS col, round({sql}, 9) AS z FROM pts GROUP BY ALL")(run)


grid_mean, grid_min, grid_max, grid_count = (_dem(m) for m in ("mean", "min", "max", "count"))


@query("soundings", """c AS (SELECT *, floor(x / 30)::BIGINT AS col, floor(y / 30)::BIGINT AS row FROM soundings),
r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY z, point_id) AS k, count(*) OVER (PARTITION BY row, col) AS n FROM c)
SELECT row, col, round(z, 6) AS z FROM r WHERE k = (n - 1) // 2 + 1""")
def grid_median_lower(spark, sf_dir):
    return grid.build_dem(views.soundings(spark, sf_dir), 30.0, "median").withColumn("z", round6(F.col("z")))


@query("soundings", """SELECT floor(y / 30)::BIGINT AS row, floor(x / 30)::BIGINT AS col, round(max(z), 6) AS z,
arg_max(x, (z, point_id)) AS tx, arg_max(y, (z, point_id)) AS ty FROM soundings GROUP BY ALL""")
def grid_shoal_true_position(spark, sf_dir):
    return grid.build_dem(views.soundings(spark, sf_dir), 30.0, "shoal").withColumn("z", round6(F.col("z")))


@query("soundings", """n AS (SELECT s.z, s.point_id, s.x, s.y, floor(y / 60)::BIGINT + a AS row, floor(x / 60)::BIGINT + b AS col
FROM soundings s, range(-1, 2) t(a), range(-1, 2) u(b)),
d AS (SELECT *, greatest(sqrt(((col + .5) * 60 - x) ** 2 + ((row + .5) * 60 - y) ** 2), 1e-9) AS d FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d, point_id) AS k FROM d WHERE d <= 60)
SELECT row, col, round(sum(z * d ** -2) / sum(d ** -2), 6) AS z FROM k WHERE k <= 12 GROUP BY ALL""")
def grid_idw(spark, sf_dir):
    return grid.idw_dem(views.soundings(spark, sf_dir), 60.0, radius=60.0).withColumn("z", round6(F.col("z")))


@query("pts", """SELECT floor(min(x) / 8) * 8 AS x0, ceil(max(y) / 8) * 8 AS ytop,
greatest(1, ceil((ceil(max(y) / 8) * 8 - floor(min(y) / 8) * 8) / 8 - 1e-9))::BIGINT AS rows,
greatest(1, ceil((ceil(max(x) / 8) * 8 - floor(min(x) / 8) * 8) / 8 - 1e-9))::BIGINT AS cols FROM pts""")
def grid_extent(spark, sf_dir):
    return grid.grid_extent(views.pts(spark, sf_dir), CELL)


def _thin(mode: str):
    def run(spark, sf_dir: str) -> DataFrame:
        return grid.thin_grid(views.pts(spark, sf_dir), CELL, mode).select("row", "col", "point_id")

    run.__name__ = f"thin_{mode}"
    pick = {"first": "min(point_id)", "min": "arg_min(point_id, (z, point_id))", "max": "arg_max(point_id, (z, point_id))"}.get(mode)
    sql = f"c AS ({PTS_CELLS}) SELECT row, col, {pick} AS point_id FROM c GROUP BY row, col"
    if mode == "median":
        sql = f"""c AS ({PTS_CELLS}), r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY z, point_id) AS k,
        count(*) OVER (PARTITION BY row, col) AS n FROM c) SELECT row, col, point_id FROM r WHERE k = (n - 1) // 2 + 1"""
    return query("pts", sql)(run)


thin_first, thin_min, thin_max, thin_median = (_thin(m) for m in ("first", "min", "max", "median"))


@query("vec3", """v AS (SELECT *, floor(x / .1)::BIGINT AS vx, floor(y / .1)::BIGINT AS vy, floor(z / .1)::BIGINT AS vz FROM vec3),
m AS (SELECT vx, vy, vz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM v GROUP BY ALL)
SELECT vx, vy, vz, arg_min(point_id, (round((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2, 12), point_id)) AS point_id FROM v JOIN m USING (vx, vy, vz) GROUP BY ALL""")
def voxel_thin(spark, sf_dir):
    return grid.voxel_thin(views.vec3(spark, sf_dir), 0.1)


MEDIAN_REST = """s AS (SELECT floor(x / 24)::BIGINT AS col, floor(y / 24)::BIGINT AS row, quantile_cont(z, .5) AS sz FROM pts GROUP BY ALL HAVING count(z) >= 3),
b AS (SELECT point_id, floor(x / 24 - .5)::BIGINT AS c0, floor(y / 24 - .5)::BIGINT AS r0, x / 24 - .5 - floor(x / 24 - .5) AS fx, y / 24 - .5 - floor(y / 24 - .5) AS fy FROM pts),
k AS (SELECT point_id, r0 + dr AS row, c0 + dc AS col, (CASE dc WHEN 0 THEN 1 - fx ELSE fx END) * (CASE dr WHEN 0 THEN 1 - fy ELSE fy END) AS w FROM b, range(0, 2) t(dr), range(0, 2) u(dc)),
f AS (SELECT point_id, sum(w * sz) / sum(w) AS ref FROM k JOIN s USING (row, col) GROUP BY point_id HAVING sum(w) > 1e-12),
r AS (SELECT p.*, z - ref AS residual, floor(x / 24)::BIGINT AS col, floor(y / 24)::BIGINT AS row FROM pts p JOIN f USING (point_id))"""


@query("pts", f"{MEDIAN_REST} SELECT point_id, round(residual, 6) AS residual FROM r WHERE abs(residual) > 150")
def median_surface_outliers_abs(spark, sf_dir):
    found = grid.median_outliers(views.pts(spark, sf_dir), 24.0, "abs", 150.0)
    return found.withColumn("residual", round6(F.col("residual")))


@query("pts", f"""{MEDIAN_REST}, a AS (SELECT 1.4826 * quantile_cont(abs(residual), .5) AS g FROM r),
l AS (SELECT row, col, 1.4826 * quantile_cont(abs(residual), .5) AS m, count(*) AS n FROM r GROUP BY ALL)
SELECT point_id, round(residual, 6) AS residual FROM r JOIN l USING (row, col), a
WHERE abs(residual) > 3 * greatest(CASE WHEN n >= 5 THEN m ELSE g END, .5 * g, 1e-3)""")
def median_surface_outliers_mad(spark, sf_dir):
    found = grid.median_outliers(views.pts(spark, sf_dir), 24.0, "mad", 3.0)
    return found.withColumn("residual", round6(F.col("residual")))


@query("pts", f"{MEDIAN_REST} SELECT point_id, round(z - residual, 6) AS ref FROM r")
def surface_at_points(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    at = grid.surface_at(p, grid.median_surface(p, 24.0), 24.0).where("ref is not null")
    return at.select("point_id", round6(F.col("ref")).alias("ref"))


# ---- points -----------------------------------------------------------------------------------------------------------


@query("pts", "SELECT point_id FROM pts WHERE z < 20 OR z > 300")
def z_range(spark, sf_dir):
    return points.outside_range(views.pts(spark, sf_dir), 20.0, 300.0).select("point_id")


@query("pts", "SELECT point_id, classification FROM pts WHERE classification NOT IN (7, 18) AND classification IN (2, 3)")
def class_filter(spark, sf_dir):
    return points.active(views.pts(spark, sf_dir)).where(F.col("classification").isin(2, 3)).select("point_id", "classification")


@query("pts", """b AS (SELECT point_id, x, y, ((x - 100) * 300 + (y - 3) * 4) / sqrt(90016) AS along, ((x - 100) * 4 - (y - 3) * 300) / sqrt(90016) AS across FROM pts)
SELECT point_id FROM b WHERE along BETWEEN 0 AND sqrt(90016) AND abs(across) <= 2.5""")
def box_subset(spark, sf_dir):
    return points.box_subset(views.pts(spark, sf_dir), (100.0, 3.0), (400.0, 7.0), 5.0).select("point_id")


@query("pts", """b AS (SELECT ((x - 100) * 300 + (y - 3) * 4) / sqrt(90016) AS a1, ((x - 100) * 4 - (y - 3) * 300) / sqrt(90016) AS c1, x - 500 AS a2, -(y - 5) AS c2 FROM pts)
SELECT round(avg(((a1 BETWEEN 0 AND sqrt(90016) AND abs(c1) <= 2.5) OR (a2 BETWEEN 0 AND 100 AND abs(c2) <= 5))::INT), 6) AS share FROM b""")
def box_coverage(spark, sf_dir):
    boxes = [((100.0, 3.0), (400.0, 7.0), 5.0), ((500.0, 5.0), (600.0, 5.0), 10.0)]
    return points.box_coverage(views.pts(spark, sf_dir), boxes).select(round6(F.col("share")).alias("share"))


def _crossings(ring) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            parts.append(f"((({y1} > y) <> ({y2} > y)) AND x < ({x2} - {x1}) * (y - {y1}) / ({y2} - {y1}) + {x1})::INT")
    return f"({' + '.join(parts)}) % 2 = 1"


@query("pts", f"SELECT point_id FROM pts WHERE {_crossings(CONCAVE)}")
def polygon_subset(spark, sf_dir):
    return points.polygon_subset(views.pts(spark, sf_dir), CONCAVE).select("point_id")


def _segments_sql() -> str:
    rows, cum = [], 0.0
    for i, ((x1, y1), (x2, y2)) in enumerate(zip(LINE, LINE[1:])):
        length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        rows.append(f"({i}, {x1}::DOUBLE, {y1}::DOUBLE, {(x2 - x1) / length!r}::DOUBLE, {(y2 - y1) / length!r}::DOUBLE, {length!r}::DOUBLE, {cum!r}::DOUBLE)")
        cum += length
    return "(VALUES " + ", ".join(rows) + ") s(seg, x1, y1, ux, uy, len, cum)"


@query("pts", f"""a AS (SELECT point_id, seg, cum, x, y, x1, y1, ux, uy, greatest(0, least(len, (x - x1) * ux + (y - y1) * uy)) AS t FROM pts, {_segments_sql()}),
d AS (SELECT point_id, seg, t + cum AS ch, (x - x1) * uy - (y - y1) * ux AS off, sqrt((x - x1 - t * ux) ** 2 + (y - y1 - t * uy) ** 2) AS d FROM a),
k AS (SELECT point_id, arg_min(ch, (d, seg)) AS ch, arg_min(off, (d, seg)) AS off, min(d) AS dist FROM d GROUP BY point_id)
SELECT point_id, round(ch, 6) AS ch, round(off, 6) AS off, round(dist, 6) AS dist FROM k WHERE dist <= 2""")
def corridor_points(spark, sf_dir):
    found = points.corridor_points(views.pts(spark, sf_dir), LINE, 2.0)
    return found.select("point_id", *[round6(F.col(c)).alias(c) for c in ("ch", "off", "dist")])


@query("pts", """SELECT count(*) AS n, min(x) AS x_min, max(x) AS x_max, round(avg(x), 6) AS x_mean, min(y) AS y_min, max(y) AS y_max, round(avg(y), 6) AS y_mean,
min(z) AS z_min, max(z) AS z_max, round(avg(z), 6) AS z_mean, round(stddev_pop(z), 6) AS z_std FROM pts""")
def describe_points(spark, sf_dir):
    found = points.describe(views.pts(spark, sf_dir))
    return found.withColumns({c: round6(F.col(c)) for c in ("x_mean", "y_mean", "z_mean", "z_std")})


@query("pts", "SELECT classification, count(*) AS n FROM pts GROUP BY 1 ORDER BY n DESC, 1 LIMIT 6")
def class_histogram_top6(spark, sf_dir):
    return points.top_classes(views.pts(spark, sf_dir))


A, B = "SELECT point_id FROM pts WHERE z < 50", "SELECT point_id FROM pts WHERE x < 200"


def _selection(op: str):
    def run(spark, sf_dir: str) -> DataFrame:
        p = views.pts(spark, sf_dir)
        return points.selection(p.where("z < 50"), p.where("x < 200"), op)

    run.__name__ = f"selection_{op}"
    return query("pts", {"replace": B, "add": f"SELECT * FROM ({A} UNION {B})", "subtract": f"SELECT * FROM ({A} EXCEPT {B})"}[op])(run)


selection_replace, selection_add, selection_subtract = (_selection(o) for o in ("replace", "add", "subtract"))


@query("pts", f"SELECT * FROM (SELECT point_id FROM pts EXCEPT {A})")
def selection_invert(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    return points.invert(p.where("z < 50"), p)


LOG = "l(seq, action, batch, point_id) AS (SELECT 1, 'delete', 1, point_id FROM pts WHERE z > 300 UNION ALL SELECT 2, 'delete', 2, point_id FROM pts WHERE x < 50 UNION ALL SELECT 3, 'restore', 1, point_id FROM pts WHERE z > 400 UNION ALL SELECT 4, 'purge', 2, point_id FROM pts WHERE x < 10)"


def _log(p: DataFrame) -> DataFrame:
    row = lambda seq, action, batch, where: p.where(where).select(F.lit(seq).alias("seq"), F.lit(action).alias("action"), F.lit(batch).alias("batch"), "point_id")
    return row(1, "delete", 1, "z > 300").union(row(2, "delete", 2, "x < 50")).union(row(3, "restore", 1, "z > 400")).union(row(4, "purge", 2, "x < 10"))


def _folded(upto: str) -> str:
    return f"""{LOG}, f AS (SELECT point_id, arg_max(action, seq) AS a, arg_max(batch, seq) AS b FROM l WHERE seq <= {upto} GROUP BY point_id)
    SELECT point_id, coalesce(CASE a WHEN 'delete' THEN b WHEN 'purge' THEN -b END, 0) AS deleted_batch FROM pts LEFT JOIN f USING (point_id)"""


@query("pts", _folded("4"))
def edit_log_active(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    return points.fold_edits(p, _log(p)).select("point_id", "deleted_batch")


@query("pts", _folded("2"))
def edit_log_undo(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    return points.fold_edits(p, _log(p), upto=2).select("point_id", "deleted_batch")


@query("pts", "SELECT point_id, CASE WHEN z > 300 THEN 7 ELSE classification END AS classification, classification AS orig_class FROM pts")
def set_class(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    edited = points.set_class(p, p.where("z > 300").select("point_id", F.lit(7).alias("new_class")))
    return edited.select("point_id", "classification", "orig_class")


# ---- neighbours -------------------------------------------------------------------------------------------------------

D3 = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"
KNN = f"""d AS (SELECT a.point_id AS a, b.point_id AS b, {D3} AS d FROM vec3 a, vec3 b WHERE a.point_id <> b.point_id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM d),
m AS (SELECT a, avg(d) AS mean_d FROM k WHERE rank <= 8 GROUP BY a)"""


@query("vec3", f"{KNN} SELECT a AS point_id, round(mean_d, 6) AS mean_d FROM m")
def knn_mean_distance(spark, sf_dir):
    v = views.vec3(spark, sf_dir)
    return knn.mean_distances(v, 8).select("point_id", round6(F.col("mean_d")).alias("mean_d"))


@query("vec3", f"{KNN} SELECT a AS point_id, round(mean_d, 6) AS mean_d FROM m WHERE mean_d > (SELECT avg(mean_d) + 2 * stddev_pop(mean_d) FROM m)")
def sor(spark, sf_dir):
    return knn.statistical_outliers(views.vec3(spark, sf_dir), 8, 2.0, 0.08).withColumn("mean_d", round6(F.col("mean_d")))


@query("vec3", f"""n AS (SELECT a.point_id, count(b.point_id) AS n FROM vec3 a LEFT JOIN vec3 b ON a.point_id <> b.point_id AND {D3} <= .08 GROUP BY a.point_id)
SELECT point_id, n FROM n WHERE n < 3""")
def radius_outlier(spark, sf_dir):
    return knn.radius_outliers(views.vec3(spark, sf_dir), 0.08, 3)


TABLE = """t AS (SELECT structure_id AS id, x, y, diameter * y AS value FROM structures),
d AS (SELECT p.point_id, t.id, t.value, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) AS d FROM q p, t),
k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, id) AS k FROM d)"""


def _match(spark, sf_dir: str, near: DataFrame, method: str) -> DataFrame:
    table = views.structures(spark, sf_dir).select(F.col("structure_id").alias("point_id"), "x", "y", (F.col("diameter") * F.col("y")).alias("value"))
    return knn.match_table(near, table, 8.0, 6.0, method).withColumn("value", round6(F.col("value")))


def _matched(name: str, method: str):
    def run(spark, sf_dir: str) -> DataFrame:
        return _match(spark, sf_dir, views.pts(spark, sf_dir), method)

    run.__name__ = name
    k = 1 if method == "nearest" else 4
    return query(
        "pts structures",
        f"""q AS (SELECT * FROM pts), {TABLE} SELECT point_id, round(sum(value * greatest(d, 1e-9) ** -2) / sum(greatest(d, 1e-9) ** -2), 6) AS value
        FROM k WHERE k <= {k} GROUP BY point_id HAVING min(d) <= 6""",
    )(run)


nearest_table, idw_table = _matched("nearest_table", "nearest"), _matched("idw_table", "idw")


@query("vec3", """v AS (SELECT point_id, floor(x / .15)::BIGINT AS vx, floor(y / .15)::BIGINT AS vy, floor(z / .15)::BIGINT AS vz FROM vec3),
g AS (SELECT min(point_id) AS id, vx, vy, vz FROM v GROUP BY ALL),
e AS (SELECT a.id AS a, b.id AS b FROM g a, g b WHERE abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT v.point_id, c.component FROM v JOIN g USING (vx, vy, vz) JOIN (SELECT a AS id, min(b) AS component FROM r GROUP BY a) c USING (id)""")
def voxel_clusters(spark, sf_dir):
    return noise.voxel_components(views.vec3(spark, sf_dir), 0.15)


@query("pts", "SELECT round(sqrt((max(x) - min(x)) * (max(y) - min(y)) / count(*)), 6) AS spacing FROM pts")
def mean_spacing(spark, sf_dir):
    return knn.mean_spacing(views.pts(spark, sf_dir)).select(round6(F.col("spacing")).alias("spacing"))


# ---- surfaces ---------------------------------------------------------------------------------------------------------

BOTH = "j AS (SELECT a.row, a.col, a.z - b.z AS dz FROM epoch_cells a JOIN epoch_cells b USING (row, col) WHERE a.epoch = 1 AND b.epoch = 0)"


def _epochs(spark, sf_dir):
    cells = views.epoch_cells(spark, sf_dir)
    return cells.where("epoch = 0").drop("epoch"), cells.where("epoch = 1").drop("epoch")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Means of few values with few decimals need nine digits, so that none lies half way between two roundings."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("epoch_cells", f"""{BOTH} SELECT count(*) AS cells, round(sum(greatest(dz, 0)) * 1500, 6) AS fill, round(sum(greatest(-dz, 0)) * 1500, 6) AS cut, round(sum(dz) * 1500, 6) AS net,
(count(*) FILTER (dz > 0) * 1500)::DOUBLE AS fill_area, (count(*) FILTER (dz < 0) * 1500)::DOUBLE AS cut_area, round(avg(dz), 6) AS mean, round(stddev_pop(dz), 6) AS std,
round(min(dz), 6) AS least, round(max(dz), 6) AS most, round(quantile_cont(dz, .05), 6) AS p05, round(quantile_cont(dz, .95), 6) AS p95 FROM j""")
def compare_surfaces(spark, sf_dir):
    before, after = _epochs(spark, sf_dir)
    return _rounded(surfaces.volumes(surfaces.difference(after, before), AREA))


@query("epoch_cells", f"""{BOTH}, r AS (SELECT *, abs(dz) > 1.96 * sqrt(20 ** 2 + 30 ** 2) AS real FROM j)
SELECT count(*) AS cells, count(*) FILTER (real) AS changed, round(coalesce(sum(-dz) FILTER (real AND dz < 0), 0) * 1500, 6) AS erosion,
round(coalesce(sum(dz) FILTER (real AND dz > 0), 0) * 1500, 6) AS deposition,
round((coalesce(sum(dz) FILTER (real AND dz > 0), 0) - coalesce(sum(-dz) FILTER (real AND dz < 0), 0)) * 1500, 6) AS net FROM r""")
def dod_lod(spark, sf_dir):
    before, after = _epochs(spark, sf_dir)
    return _rounded(surfaces.dod(before, after, AREA, 20.0, 30.0))


@query("pts", f"{MEDIAN_REST} SELECT point_id, round(residual, 6) AS dz FROM r WHERE residual > 200 OR residual < -40")
def surface_deviation(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    return _rounded(surfaces.deviation(grid.surface_at(p, grid.median_surface(p, 24.0), 24.0), 200.0, 40.0))


@query("pts", f"""{MEDIAN_REST} SELECT count(*) AS n, round(avg(residual), 6) AS mean, round(stddev_pop(residual), 6) AS std,
round(quantile_cont(abs(residual), .95), 6) AS p95, round(avg((abs(residual) <= 10)::INT), 6) AS share FROM r""")
def deviation_stats(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    return _rounded(surfaces.deviation_stats(grid.surface_at(p, grid.median_surface(p, 24.0), 24.0), 10.0))


GRADIENT = """n AS (SELECT c.row, c.col, c.z, w.z AS w, e.z AS e, s.z AS s, n.z AS n FROM seabed c
LEFT JOIN seabed w ON w.row = c.row AND w.col = c.col - 1 LEFT JOIN seabed e ON e.row = c.row AND e.col = c.col + 1
LEFT JOIN seabed s ON s.row = c.row - 1 AND s.col = c.col LEFT JOIN seabed n ON n.row = c.row + 1 AND n.col = c.col),
g AS (SELECT row, col, z, coalesce((e - w) / 60, (e - z) / 30, (z - w) / 30) AS gx, coalesce((n - s) / 100, (n - z) / 50, (z - s) / 50) AS gy FROM n),
s AS (SELECT row, col, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL)"""


@query("seabed", f"""{GRADIENT} SELECT count(*) AS cells, round(avg(slope), 6) AS mean, round(max(slope), 6) AS most, round(quantile_cont(slope, .95), 6) AS p95,
round(avg((slope > 30)::INT) * 100, 6) AS over_30, round(avg((slope > 60)::INT) * 100, 6) AS over_60 FROM s""")
def slope_stats(spark, sf_dir):
    return _rounded(surfaces.slope_stats(views.seabed(spark, sf_dir), (30.0, 50.0), (30.0, 60.0)))


@query("seabed", f"""{GRADIENT} SELECT floor(((degrees(atan2(-gx, -gy)) + 22.5 + 360) % 360) / 45)::INT AS sector, count(*) AS cells FROM g
WHERE gx IS NOT NULL AND gy IS NOT NULL AND degrees(atan(sqrt(gx * gx + gy * gy))) >= .5 GROUP BY ALL""")
def aspect_sectors(spark, sf_dir):
    return surfaces.aspect_sectors(views.seabed(spark, sf_dir), (30.0, 50.0))


@query("seabed", """SELECT a.row, a.col, round(avg(abs(a.z - b.z)), 9) AS tri FROM seabed a JOIN seabed b
ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col) GROUP BY ALL""")
def tri_roughness(spark, sf_dir):
    return _rounded(surfaces.roughness(views.seabed(spark, sf_dir)), 9)


@query("seabed", """SELECT a.row, a.col, round(-(sum(b.z) - 4 * any_value(a.z)) / 900 * 100, 9) AS curvature FROM seabed a JOIN seabed b
ON abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY ALL HAVING count(*) = 4""")
def curvature(spark, sf_dir):
    return _rounded(surfaces.curvature(views.seabed(spark, sf_dir), 30.0), 9)


REGION = [(1200.0, 100.0), (3000.0, 120.0), (2600.0, 900.0), (1500.0, 700.0)]


@query("seabed", f"""i AS (SELECT z, -250 - z AS dz, (col + .5) * 30 AS x, (row + .5) * 50 AS y FROM seabed)
SELECT count(*) AS cells, round(coalesce(sum(-dz) FILTER (dz < -1e-9), 0) * 1500, 6) AS cut, round(coalesce(sum(dz) FILTER (dz > 1e-9), 0) * 1500, 6) AS fill FROM i WHERE {_crossings(REGION)}""")
def dredge_level(spark, sf_dir):
    return _rounded(surfaces.level_design(views.seabed(spark, sf_dir), (30.0, 50.0), REGION, -250.0))


@query("epoch_cells", f"""i AS (SELECT epoch AS survey, z + 250 AS h, (col + .5) * 30 AS x, (row + .5) * 50 AS y FROM epoch_cells),
v AS (SELECT 'pile' AS name, survey, sum(greatest(h, 0)) * 1500 AS above, sum(greatest(-h, 0)) * 1500 AS below, max(h) AS height FROM i WHERE {_crossings(REGION)} GROUP BY survey)
SELECT name, survey, round(above, 6) AS above, round(below, 6) AS below, round(height, 6) AS height, round(above - lag(above) OVER (ORDER BY survey), 6) AS change, round(above * 1.6, 6) AS tonnes FROM v""")
def stockpile_volumes(spark, sf_dir):
    surveys = views.epoch_cells(spark, sf_dir).withColumnRenamed("epoch", "survey")
    return _rounded(surfaces.stockpiles(surveys, (30.0, 50.0), [("pile", REGION)], -250.0, 1.6))


@query("pts", """c AS (SELECT floor(y / 24)::BIGINT AS row, floor(x / 24)::BIGINT AS col, max(z) AS dsm, min(z) FILTER (classification = 2) AS dtm,
max(z) FILTER (classification IN (3, 4)) AS t, max((classification = 5)::INT) AS building FROM pts GROUP BY ALL)
SELECT row, col, round(dsm, 6) AS dsm, round(dtm, 6) AS dtm, round(dsm - dtm, 6) AS ndsm, round(CASE WHEN t - dtm >= 2 THEN t - dtm END, 6) AS chm, building FROM c""")
def surface_models(spark, sf_dir):
    return _rounded(surfaces.surface_models(views.pts(spark, sf_dir), 24.0, (3, 4), 5))


@query("pts structures", """j AS (SELECT s.structure_id, p.z, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS r, (degrees(atan2(p.x - s.x, p.y - s.y)) + 360) % 360 AS b FROM pts p, structures s
WHERE sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) <= 40),
o AS (SELECT *, r > .6 * max(r) OVER (PARTITION BY structure_id) AS outer_ FROM j),
f AS (SELECT structure_id, quantile_cont(z, .5) FILTER (outer_) AS reference FROM o GROUP BY 1 HAVING count(*) FILTER (outer_) >= 10)
SELECT structure_id, round(any_value(reference), 6) AS reference, round(max(reference - z), 6) AS depth, round(arg_max(r, (reference - z, -r)), 6) AS at_r,
round(arg_max(b, (reference - z, -r)), 6) AS at_bearing, count(*) FILTER (reference - z > .5) AS cells_over FROM j JOIN f USING (structure_id) GROUP BY 1""")
def scour_rings(spark, sf_dir):
    ringed = surfaces.rings(views.pts(spark, sf_dir).select("z", "x", "y"), views.structures(spark, sf_dir), 5.0, F.col("x"), F.col("y"))
    return _rounded(surfaces.scour(ringed))


# ---- hydrography ------------------------------------------------------------------------------------------------------

ORDERS_SQL = "o(name, a, b, strictness) AS (VALUES ('exclusive', .15, .0075, 0), ('special', .25, .0075, 1), ('1a', .5, .013, 2), ('1b', .5, .013, 3), ('2', 1.0, .023, 4))"


@query("pts", f"""{ORDERS_SQL} SELECT name, strictness, round(avg((intensity / 40.0 <= sqrt(a * a + (b * z) ** 2))::INT) * 100, 6) AS pct, count(*) AS n FROM pts, o WHERE intensity IS NOT NULL GROUP BY ALL""")
def s44_apriori(spark, sf_dir):
    return _rounded(hydrography.within_orders(views.pts(spark, sf_dir), F.col("intensity") / 40.0, F.col("z")))


@query("pts", f"""{MEDIAN_REST}, {ORDERS_SQL} SELECT name, strictness, round(avg((abs(residual) <= sqrt(a * a + (b * z) ** 2))::INT) * 100, 6) AS pct, count(*) AS n FROM r, o GROUP BY ALL""")
def s44_aposteriori(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    rows = grid.surface_at(p, grid.median_surface(p, 24.0), 24.0)
    return _rounded(hydrography.within_orders(rows, F.col("z") - F.col("ref"), F.col("z")))


@query("pts", f"""{ORDERS_SQL}, s AS (SELECT name, strictness, avg((intensity / 40.0 <= sqrt(a * a + (b * z) ** 2))::INT) * 100 AS pct FROM pts, o GROUP BY ALL)
SELECT arg_min(name, strictness) AS best FROM s WHERE pct >= 50""")
def s44_best_order(spark, sf_dir):
    shares = hydrography.within_orders(views.pts(spark, sf_dir), F.col("intensity") / 40.0, F.col("z"))
    return hydrography.best_order(shares, 50.0)


@query("pts", f"""{MEDIAN_REST} SELECT count(*) AS n, round(avg(residual), 6) AS mean, round(stddev_pop(residual), 6) AS std, round(quantile_cont(residual, .5), 6) AS median,
round(quantile_cont(abs(residual), .95), 6) AS p95, round(max(abs(residual)), 6) AS most FROM r""")
def s44_residual_stats(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    rows = grid.surface_at(p, grid.median_surface(p, 24.0), 24.0)
    return _rounded(hydrography.residual_stats(rows.withColumn("residual", F.col("z") - F.col("ref"))))


CROSS = MEDIAN_REST.replace("FROM pts GROUP BY ALL", "FROM pts WHERE classification <> 2 GROUP BY ALL").replace("FROM pts),", "FROM pts WHERE classification = 2),")


@query("pts", f"{CROSS} SELECT point_id, round(residual, 6) AS residual FROM r")
def s44_crosslines(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    found = hydrography.crosslines(p.where("classification <> 2"), p.where("classification = 2"), 24.0).where("residual is not null")
    return _rounded(found.select("point_id", "residual"))


@query("pts", f"""{MEDIAN_REST} SELECT floor(y / 24)::BIGINT AS row, floor(x / 24)::BIGINT AS col, round(avg((abs(residual) <= sqrt(1 + (.023 * z) ** 2))::INT) * 100, 6) AS pct, count(*) AS n FROM r GROUP BY ALL""")
def s44_compliance_grid(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    rows = grid.surface_at(p, grid.median_surface(p, 24.0), 24.0)
    limit = F.sqrt(1 + F.pow(0.023 * F.col("z"), 2))
    return _rounded(hydrography.compliance_grid(rows, 24.0, F.col("z") - F.col("ref"), limit))


@query("pts", """c AS (SELECT floor(y / 4)::BIGINT AS row, floor(x / 4)::BIGINT AS col FROM pts GROUP BY ALL),
r AS (SELECT row, max(col) - min(col) + 1 AS area, count(*) AS filled FROM c GROUP BY row)
SELECT sum(area)::BIGINT AS area, sum(filled)::BIGINT AS filled, round(sum(filled) / sum(area) * 100, 6) AS pct FROM r""")
def coverage_rows(spark, sf_dir):
    return _rounded(hydrography.coverage(views.pts(spark, sf_dir), 4.0))


@query("pts", "SELECT point_id, round(coalesce(CASE WHEN intensity >= 10 THEN intensity / 100.0 END, sqrt(.25 + (.013 * z) ** 2)) / 1.96, 6) AS sigma, intensity < 10 AS from_model FROM pts")
def uncertainty_resolve(spark, sf_dir):
    own = F.when(F.col("intensity") >= 10, F.col("intensity") / 100.0)
    return _rounded(hydrography.resolve_uncertainty(views.pts(spark, sf_dir), own, F.col("z")).select("point_id", "sigma", "from_model"))


@query("pts", "SELECT point_id, round(z - 1.8, 6) AS z, false AS unmoved FROM pts")
def datum_apply_constant(spark, sf_dir):
    return _rounded(hydrography.apply_separation(views.pts(spark, sf_dir), F.lit(1.8)).select("point_id", "z", "unmoved"))


@query("pts structures", f"""q AS (SELECT * FROM pts), {TABLE}, m AS (SELECT point_id, value FROM k WHERE k = 1 AND d <= 6)
SELECT point_id, round(coalesce(z - value, z), 6) AS z, value IS NULL AS unmoved FROM pts LEFT JOIN m USING (point_id)""")
def datum_apply_table(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    table = views.structures(spark, sf_dir).select(F.col("structure_id").alias("point_id"), "x", "y", (F.col("diameter") * F.col("y")).alias("value"))
    found = knn.knn(p, table, 1, 6.0, axes=("x", "y"), limit=6.0).join(table.select(F.col("point_id").alias("b"), "value"), "b")
    rows = p.join(found.select(F.col("a").alias("point_id"), "value"), "point_id", "left")
    return _rounded(hydrography.apply_separation(rows, F.col("value")).select("point_id", "z", "unmoved"))


# Nodes lie at the centres of cells of 10 m, within the rows and columns of the soundings' own cells.
CUBE = """o AS (SELECT *, floor(x / 10)::BIGINT AS oi, floor(y / 10)::BIGINT AS oj FROM pts),
n AS (SELECT point_id, z, oi + a AS i, oj + b AS j, x, y, greatest(7.5, least(15, abs(z) * .05)) AS reach FROM o, range(-1, 2) t(a), range(-1, 2) u(b)
WHERE oi + a BETWEEN (SELECT min(oi) FROM o) AND (SELECT max(oi) FROM o) AND oj + b BETWEEN (SELECT min(oj) FROM o) AND (SELECT max(oj) FROM o)),
d AS (SELECT *, sqrt((x - (i + .5) * 10) ** 2 + (y - (j + .5) * 10) ** 2) AS r FROM n),
c AS (SELECT point_id, i, j, z, 25 * (1 + ((r + 1.96 * .5) / 10) ** 2) AS var FROM d WHERE r <= reach),
s AS (SELECT *, coalesce((z - lag(z) OVER w > 3 * sqrt(var + lag(var) OVER w))::INT, 0) AS cut FROM c WINDOW w AS (PARTITION BY i, j ORDER BY z, point_id)),
h AS (SELECT *, sum(cut) OVER (PARTITION BY i, j ORDER BY z, point_id) AS hyp FROM s),
f AS (SELECT i, j, hyp::BIGINT AS hyp, count(*) AS n, sum(z / var) / sum(1 / var) AS mean, 1 / sum(1 / var) AS var, greatest(0, sum(z * z / var) / sum(1 / var) - (sum(z / var) / sum(1 / var)) ** 2) AS spread FROM h GROUP BY ALL)"""


def _hypotheses(spark, sf_dir):
    c = hydrography.contributions(views.pts(spark, sf_dir), 10.0, F.lit(5.0), F.lit(0.5))
    return hydrography.hypotheses(c)


@query("pts", f"{CUBE} SELECT i, j, hyp, n, round(mean, 5) AS mean, round(var, 4) AS var, round(spread, 4) AS spread FROM f")
def cube_hypotheses(spark, sf_dir):
    return _hypotheses(spark, sf_dir).withColumns({"mean": F.round("mean", 5), "var": F.round("var", 4), "spread": F.round("spread", 4)})


DENSITY = f"{CUBE}, k AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY n DESC, var, hyp) AS k, count(*) OVER (PARTITION BY i, j) AS hypotheses FROM f)"
CHOSEN = "SELECT i, j, round(mean, 5) AS z, round(greatest(var, spread), 4) AS var, n, hypotheses FROM k WHERE k = 1"


@query("pts", f"{DENSITY} {CHOSEN}")
def cube_density(spark, sf_dir):
    return _cube_parts(hydrography.estimate(_hypotheses(spark, sf_dir), "density"))


@query("pts", f"""{CUBE}, t AS (SELECT *, sum(n) OVER (PARTITION BY i, j) AS all_n, count(*) OVER (PARTITION BY i, j) AS hypotheses FROM f),
g AS (SELECT *, n >= greatest(2, .1 * all_n) AS strong FROM t), e AS (SELECT *, bool_or(strong) OVER (PARTITION BY i, j) AS any_strong FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY mean DESC, n DESC, var, hyp) AS k FROM e WHERE strong OR NOT any_strong) {CHOSEN}""")
def cube_shoal(spark, sf_dir):
    return _cube_parts(hydrography.estimate(_hypotheses(spark, sf_dir), "shoal"))


@query("pts", f"""{CUBE}, p AS (SELECT *, CASE WHEN (i + j) % 2 = 0 THEN 60.0 + i END AS prior, count(*) OVER (PARTITION BY i, j) AS hypotheses FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY coalesce(abs(mean - prior) / sqrt(var + 1e-6), 1e12 - n), n DESC, var, hyp) AS k FROM p) {CHOSEN}""")
def cube_prior(spark, sf_dir):
    prior = F.when((F.col("i") + F.col("j")) % 2 == 0, 60.0 + F.col("i"))
    return _cube_parts(hydrography.estimate(_hypotheses(spark, sf_dir), "prior", prior=prior))


LOCALE = f"""{DENSITY.replace(", k AS (", ", first_k AS (")}, a AS (SELECT i, j, mean AS z FROM first_k WHERE k = 1),
w AS (SELECT a.i + d AS i, a.j + e AS j, a.z FROM a, range(-5, 6) t(d), range(-5, 6) u(e)),
m AS (SELECT i, j, quantile_cont(z, .5) AS target FROM w JOIN (SELECT i, j FROM a) USING (i, j) GROUP BY ALL),
k AS (SELECT f.*, count(*) OVER (PARTITION BY i, j) AS hypotheses, row_number() OVER (PARTITION BY i, j ORDER BY abs(mean - target) / sqrt(var + 1e-6), n DESC, var, hyp) AS k FROM f JOIN m USING (i, j))"""


@query("pts", f"{LOCALE} {CHOSEN}")
def cube_locale(spark, sf_dir):
    return _cube_parts(hydrography.estimate(_hypotheses(spark, sf_dir)))


def _cube_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({"z": F.round("z", 5), "var": F.round("var", 4)})


@query("pts", f"""{LOCALE} SELECT point_id, round(k.mean, 5) AS node_z FROM pts p JOIN k ON k.k = 1 AND k.i = floor(p.x / 10)::BIGINT AND k.j = floor(p.y / 10)::BIGINT
WHERE abs(p.z - k.mean) > 3 * sqrt(25 + greatest(k.var, k.spread))""")
def cube_flags(spark, sf_dir):
    nodes = hydrography.estimate(_hypotheses(spark, sf_dir))
    return hydrography.flags(views.pts(spark, sf_dir), nodes, 10.0, F.lit(5.0)).withColumn("node_z", F.round("node_z", 5))


@query("pts", f"""m AS (SELECT quantile_cont(z, .5) AS median, sqrt((max(x) - min(x)) * (max(y) - min(y)) / count(*)) AS s FROM pts),
f AS (SELECT CASE WHEN median > 40 THEN .1 * median ELSE 2.0 END AS fs, s FROM m) SELECT round(fs, 6) AS feature_m, round(s, 6) AS spacing_m, s <= fs / 3 AS ok FROM f""")
def s44_feature_density(spark, sf_dir):
    return _rounded(hydrography.feature_density(views.pts(spark, sf_dir), "1a", F.col("z")))


@query("pts", """o(name, strictness, a, b, c, p) AS (VALUES ('exclusive', 0, .15, .0075, 1.0, .0), ('special', 1, .25, .0075, 2.0, .0), ('1a', 2, .5, .013, 5.0, .05), ('1b', 3, .5, .013, 5.0, .05), ('2', 4, 1.0, .023, 20.0, .1)),
d AS (SELECT quantile_cont(abs(z), .5) AS d FROM pts) SELECT name, strictness, round(sqrt(a * a + (b * d) ** 2), 6)::DOUBLE AS tvu, round(c + p * d, 6)::DOUBLE AS thu FROM o, d""")
def s44_limits(spark, sf_dir):
    return _rounded(hydrography.assess(views.pts(spark, sf_dir), "1a", reference_cell=24.0, coverage=False)["limits"])


@query("pts", f"{MEDIAN_REST} SELECT point_id, round(residual, 6) AS residual, round(sqrt(.25 + (.013 * z) ** 2), 6) AS \"limit\" FROM r WHERE abs(residual) > sqrt(.25 + (.013 * z) ** 2)")
def s44_over_limit(spark, sf_dir):
    return _rounded(hydrography.assess(views.pts(spark, sf_dir), "1a", reference_cell=24.0, coverage=False)["over_limit"])


# Closing by two cells, then what is cut off from the border of a box around it counts as inside.
COVERAGE = """c AS (SELECT floor(y / 12)::BIGINT AS row, floor(x / 12)::BIGINT AS col FROM pts GROUP BY ALL),
g AS (SELECT DISTINCT row + a AS row, col + b AS col FROM c, range(-2, 3) t(a), range(-2, 3) u(b)),
k AS (SELECT row + a AS row, col + b AS col FROM g, range(-2, 3) t(a), range(-2, 3) u(b) GROUP BY ALL HAVING count(*) = 25),
z AS (SELECT row, col FROM k UNION SELECT row, col FROM c),
b AS (SELECT min(row) - 1 AS r1, max(row) + 1 AS r2, min(col) - 1 AS c1, max(col) + 1 AS c2 FROM z),
e AS (SELECT r AS row, q AS col FROM b, range(r1, r2 + 1) t(r), range(c1, c2 + 1) u(q) EXCEPT SELECT row, col FROM z),
x AS (SELECT r1 AS row, c1 AS col FROM b UNION SELECT e.row, e.col FROM x JOIN e ON abs(e.row - x.row) + abs(e.col - x.col) = 1),
w AS (SELECT row, col FROM z UNION (SELECT row, col FROM e EXCEPT SELECT row, col FROM x))"""


@query("pts", f"{COVERAGE} SELECT row, col, (row, col) IN (SELECT (row, col) FROM c) AS filled FROM w")
def s44_covered_area(spark, sf_dir):
    return hydrography.covered_area(views.pts(spark, sf_dir), 12.0)


@query("pts", f"""{COVERAGE}, n AS (SELECT row, col, row_number() OVER (ORDER BY row, col) AS id FROM w ANTI JOIN c USING (row, col)),
l AS (SELECT id, id AS root FROM n UNION SELECT q.id, l.root FROM l JOIN n ON n.id = l.id JOIN n q ON abs(q.row - n.row) + abs(q.col - n.col) = 1),
h AS (SELECT id, min(root) AS part FROM l GROUP BY id)
SELECT (SELECT count(*) FROM w) AS cells, (SELECT count(*) FROM w SEMI JOIN c USING (row, col)) AS filled, (SELECT count(*) FROM n) AS holiday_cells,
(SELECT count(DISTINCT part) FROM h) AS holidays, round((SELECT count(*) FROM w SEMI JOIN c USING (row, col)) / (SELECT count(*) FROM w) * 100, 6) AS pct""")
def s44_holidays(spark, sf_dir):
    return _rounded(hydrography.holidays(hydrography.covered_area(views.pts(spark, sf_dir), 12.0)))


@query("pts", """SELECT round(CASE WHEN n > 500 THEN 2 * sqrt(n / 500) ELSE 2 END, 6)::DOUBLE AS cell FROM (SELECT ((max(x) - min(x)) / 2 + 1) * ((max(y) - min(y)) / 2 + 1) AS n FROM pts)""")
def map_cell(spark, sf_dir):
    return _rounded(hydrography.map_cell(views.pts(spark, sf_dir), 2.0, 500.0))


@query("seabed", "SELECT floor(row / 2)::BIGINT AS row, floor(col / 2)::BIGINT AS col, round(max(z), 9) AS z FROM seabed GROUP BY ALL")
def shoal_block(spark, sf_dir):
    return _rounded(grid.block(views.seabed(spark, sf_dir), 2), 9)


@query("seabed", """SELECT a.row, a.col, round(max(b.z), 9) AS z FROM seabed a JOIN seabed b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL""")
def safety_surface(spark, sf_dir):
    return _rounded(hydrography.safety_surface(views.seabed(spark, sf_dir), 1), 9)


@query("seabed", """b AS (SELECT list_sum(list_transform([0, 2, 5, 10, 15, 20, 25, 30, 40, 50, 100, 200, 500, 1000], lambda v: (-z >= v)::INT))::INT - 1 AS band FROM seabed)
SELECT band, count(*) AS cells, count(*) * 1500.0::DOUBLE AS area FROM b GROUP BY band""")
def depth_class_area(spark, sf_dir):
    return hydrography.depth_class_area(views.seabed(spark, sf_dir), AREA)


@query("soundings", "SELECT point_id, floor(-z * 10 + 1e-6) / 10 AS valsou, floor(-z * 100 + 1e-6) / 100 AS depth FROM soundings")
def soundings_valsou(spark, sf_dir):
    s = views.soundings(spark, sf_dir)
    return s.select("point_id", hydrography.valsou(-F.col("z")).alias("valsou"), hydrography.chart_depth(-F.col("z")).alias("depth"))


@query()
def select_soundings(spark, sf_dir):
    return hydrography.select_soundings(views.soundings(spark, sf_dir), 25.0).select("point_id", "x", "y", "z")


# ---- ground and colour ------------------------------------------------------------------------------------------------


@query("pts", """c AS (SELECT *, floor(x / 24)::BIGINT AS col, floor(y / 24)::BIGINT AS row FROM pts),
m AS (SELECT *, row_number() OVER (w ORDER BY intensity, point_id) - 1 AS r, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY row, col)),
d AS (SELECT *, max(CASE WHEN r = n // 2 THEN intensity END) OVER (PARTITION BY row, col) AS mid FROM m),
v AS (SELECT *, abs(intensity - mid) AS dev FROM d), q AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY dev, point_id) - 1 AS r2 FROM v),
f AS (SELECT *, max(CASE WHEN r2 = n // 2 THEN dev END) OVER (PARTITION BY row, col) AS mad FROM q)
SELECT point_id, intensity FROM f WHERE intensity > mid + 1.2 * 1.4826 * mad AND intensity >= (SELECT quantile_cont(intensity, .8) FROM pts)""")
def marking_candidates(spark, sf_dir):
    return ground.marking_candidates(views.pts(spark, sf_dir), 24.0, 1.2, 80.0)


def _bilinear(surface: str, name: str, cell: int) -> str:
    """Clauses that give point_id and ref: the surface's bilinear value over the corners that hold data, else that of the point's own cell."""
    return f"""{name}_b AS (SELECT point_id, floor(x / {cell} - .5)::BIGINT AS c0, floor(y / {cell} - .5)::BIGINT AS r0, x / {cell} - .5 - floor(x / {cell} - .5) AS fx, y / {cell} - .5 - floor(y / {cell} - .5) AS fy FROM pts),
{name}_k AS (SELECT point_id, r0 + dr AS row, c0 + dc AS col, (CASE dc WHEN 0 THEN 1 - fx ELSE fx END) * (CASE dr WHEN 0 THEN 1 - fy ELSE fy END) AS w FROM {name}_b, range(0, 2) t(dr), range(0, 2) u(dc)),
{name}_f AS (SELECT point_id, sum(w * s.z) / sum(w) AS ref FROM {name}_k JOIN {surface} s USING (row, col) GROUP BY point_id HAVING sum(w) > 1e-12),
{name} AS (SELECT p.point_id, coalesce(f.ref, o.z) AS ref FROM pts p LEFT JOIN {name}_f f USING (point_id) LEFT JOIN {surface} o ON o.row = floor(p.y / {cell})::BIGINT AND o.col = floor(p.x / {cell})::BIGINT)"""


def _slope(surface: str, name: str, cell: int) -> str:
    one = lambda a, b: f"coalesce(({a}.z - {b}.z) / 2, {a}.z - o.z, o.z - {b}.z, 0) / {cell}"
    beside = " ".join(f"LEFT JOIN {surface} {n} ON {n}.row = o.row + {dr} AND {n}.col = o.col + {dc}" for n, dr, dc in (("e", 0, 1), ("w", 0, -1), ("n", 1, 0), ("s", -1, 0)))
    return f"{name} AS (SELECT o.row, o.col, sqrt(({one('e', 'w')}) ** 2 + ({one('n', 's')}) ** 2) AS z FROM {surface} o {beside})"


def _opened(surface: str, name: str, reach: int) -> str:
    beside = lambda a: f"FROM {a} a JOIN {a} b ON b.row BETWEEN a.row - {reach} AND a.row + {reach} AND b.col BETWEEN a.col - {reach} AND a.col + {reach} GROUP BY ALL"
    return f"{name}_e AS MATERIALIZED (SELECT a.row, a.col, min(b.z) AS z {beside(surface)}), {name} AS MATERIALIZED (SELECT a.row, a.col, max(b.z) AS z {beside(name + '_e')})"


def _lowest(cell: int) -> str:
    return f"l AS MATERIALIZED (SELECT floor(y / {cell})::BIGINT AS row, floor(x / {cell})::BIGINT AS col, min(z) AS z FROM pts GROUP BY ALL)"


@query("pts", f"""{_lowest(24)}, m AS MATERIALIZED (SELECT a.row, a.col, avg(b.z) AS z FROM l a JOIN l b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL),
{_slope("m", "g", 24)}, {_bilinear("m", "h", 24)}, {_bilinear("g", "i", 24)}
SELECT point_id, z - h.ref <= 5 + i.ref * 24 AS ground FROM pts JOIN h USING (point_id) JOIN i USING (point_id)""")
def ground_grid_minimum(spark, sf_dir):
    return ground.grid_minimum(views.pts(spark, sf_dir), 24.0, 5.0)


# Windows of 3, 5 and 9 cells of 8 m fit into 72 m; their limits are 0.15, 2.5 (0.15 + 0.1 * 16) and so on.
@query("pts", f"""{_lowest(8)}, {_opened("l", "a3", 1)}, {_opened("a3", "a5", 2)}, {_opened("a5", "a9", 4)}, p AS (SELECT *, floor(y / 8)::BIGINT AS row, floor(x / 8)::BIGINT AS col FROM pts)
SELECT point_id, p.z - a3.z <= .15 AND p.z - a5.z <= .15 + .1 * 2 * 8 AND p.z - a9.z <= .15 + .1 * 2 * 8 AS ground
FROM p JOIN a3 USING (row, col) JOIN a5 USING (row, col) JOIN a9 USING (row, col)""")
def ground_pmf(spark, sf_dir):
    return ground.pmf(views.pts(spark, sf_dir), 8.0, 72.0, 0.1)


@query("pts", f"""{_lowest(8)}, {_opened("l", "a1", 1)}, {_opened("l", "a2", 2)}, {_opened("l", "a3", 3)},
x AS (SELECT row, col FROM l JOIN a1 USING (row, col) WHERE l.z - a1.z > 1.0 * 1 * 8 UNION SELECT row, col FROM a1 JOIN a2 USING (row, col) WHERE a1.z - a2.z > 1.0 * 2 * 8
UNION SELECT row, col FROM a2 JOIN a3 USING (row, col) WHERE a2.z - a3.z > 1.0 * 3 * 8), bare AS MATERIALIZED (SELECT l.* FROM l ANTI JOIN x USING (row, col)),
{_slope("bare", "g", 8)}, {_bilinear("bare", "h", 8)}, {_bilinear("g", "i", 8)}
SELECT point_id, coalesce(abs(z - h.ref) <= 5 + 1.25 * coalesce(i.ref, 0), false) AS ground, round(z - h.ref, 6) AS height FROM pts JOIN h USING (point_id) JOIN i USING (point_id)""")
def ground_smrf(spark, sf_dir):
    return _rounded(ground.smrf(views.pts(spark, sf_dir), 8.0, 1.0, 24.0, 5.0))


@query("pts", f"""{_lowest(8)}, {_opened("l", "a3", 1)}, p AS (SELECT *, floor(y / 8)::BIGINT AS row, floor(x / 8)::BIGINT AS col FROM pts),
d AS MATERIALIZED (SELECT point_id, x, y, p.z, p.z - a3.z <= .15 AS ground FROM p JOIN a3 USING (row, col)),
s AS MATERIALIZED (SELECT floor(y / 8)::BIGINT AS row, floor(x / 8)::BIGINT AS col, avg(z) AS z FROM d WHERE ground GROUP BY ALL), {_bilinear("s", "h", 8)},
v AS (SELECT point_id, ground, CASE WHEN NOT ground THEN z - ref END AS height FROM d JOIN h USING (point_id))
SELECT point_id, ground, round(height, 6) AS height, CASE WHEN ground THEN 2 WHEN height IS NULL OR height < 20 THEN 1 WHEN height < 60 THEN 3 WHEN height < 150 THEN 4 ELSE 5 END AS "class" FROM v""")
def ground_classify(spark, sf_dir):
    return _rounded(ground.classify(views.pts(spark, sf_dir), "pmf", 8.0, (20.0, 60.0, 150.0), cell=8.0, max_window=24.0).select("point_id", "ground", "height", "class"))


@query("pts", "SELECT round(quantile_cont(z, .02), 6) AS low, round(quantile_cont(z, .98), 6) AS high FROM pts")
def color_range(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    return _rounded(p.agg(F.percentile("z", F.lit(0.02)).alias("low"), F.percentile("z", F.lit(0.98)).alias("high")))


@query("pts", "SELECT point_id, least(255, greatest(0, floor((z - 10) * 255 / 300)))::INT AS slot FROM pts")
def map_scalar(spark, sf_dir):
    slot = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("z") - 10) * 255 / 300)))
    return views.pts(spark, sf_dir).select("point_id", slot.cast("int").alias("slot"))
