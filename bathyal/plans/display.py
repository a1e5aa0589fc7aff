"""Queries over ranges, ticks, shading and facts that a display shows, and over reports of routes; each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bathyal.operators import display, mesh, points, routes
from bathyal.operators.graph import saved
from bathyal.plans.registry import query
from bathyal.sources import views


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("pts", """s AS (SELECT point_id, z, 10 ** floor(log10(z)) AS m FROM pts WHERE z > 0)
SELECT point_id, round(CASE WHEN m >= z * .999 THEN m WHEN 2 * m >= z * .999 THEN 2 * m WHEN 2.5 * m >= z * .999 THEN 2.5 * m WHEN 5 * m >= z * .999 THEN 5 * m ELSE 10 * m END, 6)::DOUBLE AS nice FROM s
UNION ALL SELECT point_id, 1 FROM pts WHERE NOT z > 0""")
def nice_numbers(spark, sf_dir):
    return _rounded(views.pts(spark, sf_dir).select("point_id", display.nice_number(F.col("z")).alias("nice")))


@query("profile", """b AS (SELECT route_id, min(z) AS lo, max(z) AS hi FROM profile GROUP BY 1), r AS (SELECT *, (hi - lo) / 6 AS raw FROM b WHERE hi > lo),
m AS (SELECT *, 10 ** floor(log10(raw)) AS m FROM r), s AS (SELECT *, CASE WHEN m >= raw THEN m WHEN 2 * m >= raw THEN 2 * m WHEN 2.5 * m >= raw THEN 2.5 * m WHEN 5 * m >= raw THEN 5 * m ELSE 10 * m END AS step FROM m)
SELECT route_id, count(*) AS n, round(min(k * step), 6)::DOUBLE AS first, round(max(k * step), 6)::DOUBLE AS last FROM s, range(-20000, 20000) t(k)
WHERE k >= ceil(lo / step - 1e-9) AND k * step <= hi + step * 1e-9 GROUP BY 1""")
def axis_ticks(spark, sf_dir):
    b = views.profile(spark, sf_dir).groupBy("route_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi")).where("hi > lo")
    t = b.select("route_id", F.explode(display.nice_ticks(F.col("lo"), F.col("hi"))).alias("t"))
    return _rounded(t.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last")))


@query("pts", "SELECT -m AS low, m AS high FROM (SELECT round(greatest(abs(quantile_cont(z - 100, .02)), abs(quantile_cont(z - 100, .98)), 1e-3), 6) AS m FROM pts)")
def symmetric_range(spark, sf_dir):
    return _rounded(display.symmetric_range(views.pts(spark, sf_dir), F.col("z") - 100))


@query("pts", "SELECT min(z) AS low, max(z) AS high FROM pts")
def full_range(spark, sf_dir):
    return display.full_range(views.pts(spark, sf_dir), F.col("z"))


@query("pts", """d AS (SELECT point_id, z - 100 AS v FROM pts) SELECT point_id, round(CASE WHEN v < 0 THEN .5 * (v + 120) / 120 ELSE .5 + .5 * v / 400 END, 9) AS both,
round(.5 * (v + 120) / 120, 9) AS sea, round(.5 + .5 * (v - 10) / 390, 9) AS land FROM d""")
def topo_position(spark, sf_dir):
    v = F.col("z") - 100
    parts = [display.topo_position(v, a, b).alias(n) for a, b, n in ((-120.0, 400.0, "both"), (-120.0, 0.0, "sea"), (10.0, 400.0, "land"))]
    return _rounded(views.pts(spark, sf_dir).select("point_id", *parts), 9)


def _coloured(spark, sf_dir: str) -> DataFrame:
    i = F.col("intensity")
    return views.pts(spark, sf_dir).withColumns({"r": i * 300, "g": i * 100, "b": i})


@query("pts", "m AS (SELECT CASE WHEN max(intensity * 300) > 255 THEN 65535 ELSE 255 END AS s FROM pts) SELECT point_id, round(coalesce(intensity * 300 / s, 0), 6)::DOUBLE AS r, round(coalesce(intensity * 100 / s, 0), 6)::DOUBLE AS g, round(coalesce(intensity / s, 0), 6)::DOUBLE AS b FROM pts, m")
def rgb_colors(spark, sf_dir):
    return _rounded(display.rgb_colors(_coloured(spark, sf_dir)))


@query("pts", """SELECT mode, n FROM (SELECT unnest(['elevation', 'intensity', 'rgb', 'classification', 'single']) AS mode,
unnest([count(z), count(intensity), count(*), count(classification), count(*)]) AS n FROM pts)""")
def color_modes(spark, sf_dir):
    """The modes there are, and how many points have a value to be coloured by."""
    p = _coloured(spark, sf_dir)
    by = {"elevation": "z", "rgb": "r", "single": "point_id"}
    counts = [F.count(by.get(m, m)).alias(m) for m in display.available_modes(p)]
    return p.agg(*counts).select(F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in display.available_modes(p)]), F.array(*display.available_modes(p)))).alias("mode", "n"))


@query("pts", "SELECT route_id, CASE WHEN n * n > 100 THEN ceil(sqrt(n * n / 100)) ELSE 1 END::INT AS stride FROM (SELECT y::BIGINT AS route_id, count(*) AS n FROM pts GROUP BY 1)")
def grid_stride(spark, sf_dir):
    n = views.profile(spark, sf_dir).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("route_id", display.stride(F.col("n"), F.col("n"), 100).alias("stride"))


@query("pts", "SELECT max(classification) AS max_class FROM pts")
def max_class(spark, sf_dir):
    return display.max_class(views.pts(spark, sf_dir))


@query("pts", "SELECT count(*) AS n_noise FROM pts WHERE classification + 4 IN (7, 18)")
def noise_count(spark, sf_dir):
    return display.noise_count(views.pts(spark, sf_dir).withColumn("classification", F.col("classification") + 4))


@query("pts", "SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM pts")
def bounding_box(spark, sf_dir):
    return display.bounding_box(views.pts(spark, sf_dir))


@query("pts", "SELECT CASE WHEN x < 100 THEN 3 WHEN z > 300 THEN 1 END AS batch, count(*) AS n FROM pts WHERE x < 100 OR z > 300 GROUP BY 1")
def trash_batches(spark, sf_dir):
    batch = F.when(F.col("x") < 100, 3).when(F.col("z") > 300, 1).when(F.col("y") < 20, -2).otherwise(0)
    return display.trash_batches(views.pts(spark, sf_dir).withColumn("deleted_batch", batch))


@query("pts", "SELECT count(*) AS total FROM pts WHERE x < 100 OR z > 300")
def trash_total(spark, sf_dir):
    batch = F.when(F.col("x") < 100, 3).when(F.col("z") > 300, 1).when(F.col("y") < 20, -2).otherwise(0)
    return display.trash_total(views.pts(spark, sf_dir).withColumn("deleted_batch", batch))


@query("pts", "SELECT count(*) FILTER (z < 50) AS selected, 0::BIGINT AS cleared, count(*) AS points FROM pts")
def selection_clear(spark, sf_dir):
    """How many points are selected before and after, and how many there are."""
    p = views.pts(spark, sf_dir)
    chosen = p.where("z < 50").select("point_id")
    flags = lambda s, name: p.join(s.withColumn("on", F.lit(True)), "point_id", "left").agg(F.count("on").alias(name))
    return flags(chosen, "selected").crossJoin(flags(display.cleared(chosen), "cleared")).crossJoin(p.agg(F.count(F.lit(1)).alias("points")))  # each is one row


@query("seabed", "SELECT row, col, (col + .5) * 30::DOUBLE AS x, (row + .5) * 30::DOUBLE AS y FROM seabed")
def cell_centres(spark, sf_dir):
    return display.centres(views.seabed(spark, sf_dir), 30.0).select("row", "col", "x", "y")


@query("pts", "SELECT point_id, -z AS down, z AS up, abs(z) AS either_way FROM pts")
def depths(spark, sf_dir):
    z = F.col("z")
    return views.pts(spark, sf_dir).select("point_id", display.depth_of(z).alias("down"), display.depth_of(z, False).alias("up"), display.depth_of(z, None).alias("either_way"))


@query("vec3", """n AS (SELECT point_id, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM vec3),
d AS (SELECT *, degrees(acos(least(1, abs(z)))) AS dip FROM n)
SELECT point_id, round(dip, 5) AS dip, round(CASE WHEN dip > .5 THEN (degrees(atan2(CASE WHEN z < 0 THEN -x ELSE x END, CASE WHEN z < 0 THEN -y ELSE y END)) + 360) % 360 ELSE 0 END, 5) AS direction FROM d""")
def plane_dips(spark, sf_dir):
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    n = [F.col(c) / size for c in ("x", "y", "z")]
    return _rounded(views.vec3(spark, sf_dir).select("point_id", display.dip(*n).alias("dip"), display.dip_direction(*n).alias("direction")), 5)


@query("pts", """b AS (SELECT round((min(x) + max(x)) / 2) AS mx, round((min(y) + max(y)) / 2) AS my, round((min(z) + max(z)) / 2) AS mz FROM pts)
SELECT point_id, round((x - mx)::FLOAT::DOUBLE, 2) AS x, round((y - my)::FLOAT::DOUBLE, 2) AS y, round((z - mz)::FLOAT::DOUBLE, 2) AS z FROM pts, b""")
def local_coordinates(spark, sf_dir):
    found = points.local_coordinates(views.pts(spark, sf_dir))
    return found.select("point_id", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("x", "y", "z")])


@query("pts", "SELECT arg_min(point_id, (z * (1 + .002 * sqrt((x - 300) ** 2 + (y - 40) ** 2)), point_id)) AS point_id FROM pts WHERE sqrt((x - 300) ** 2 + (y - 40) ** 2) <= 60")
def pick_point(spark, sf_dir):
    seen = views.pts(spark, sf_dir).withColumns({"sx": F.col("x"), "sy": F.col("y"), "w": F.col("z")})
    return points.pick(seen, 300.0, 40.0, 60.0)


@query("pts", "SELECT point_id, CASE WHEN classification + 4 IN (7, 18) THEN 1 ELSE classification + 4 END AS classification FROM pts")
def original_classes(spark, sf_dir):
    p = views.pts(spark, sf_dir).withColumn("orig_class", F.col("classification") + 4).withColumn("classification", F.lit(9))
    return points.original_class(p).select("point_id", "classification")


@query("pts", """b AS (SELECT point_id, ((x - 340) * 300 + (y - 6.2) * 4) / sqrt(90016) AS along, ((x - 340) * 4 - (y - 6.2) * 300) / sqrt(90016) AS across FROM pts)
SELECT point_id FROM b WHERE along BETWEEN 0 AND sqrt(90016) AND abs(across) <= 2.5""")
def next_box(spark, sf_dir):
    """The page after a box, with an overlap of a fifth."""
    p0, p1 = points.next_box((100.0, 3.0), (400.0, 7.0), 0.2)
    return points.box_subset(views.pts(spark, sf_dir), p0, p1, 5.0).select("point_id")


# ---- meshes of whole surfaces -------------------------------------------------------------------------------------------

SQUARES = """q AS (SELECT a.row, a.col, a.z AS z00, b.z AS z01, d.z AS z10, c.z AS z11 FROM seabed a JOIN seabed b ON b.row = a.row AND b.col = a.col + 1
JOIN seabed d ON d.row = a.row + 1 AND d.col = a.col JOIN seabed c ON c.row = a.row + 1 AND c.col = a.col + 1),
t AS (SELECT row, col, 0 AS h, row AS ar, col AS ac, z00 AS az, row AS br, col + 1 AS bc, z01 AS bz, row + 1 AS cr, col + 1 AS cc, z11 AS cz FROM q
UNION ALL SELECT row, col, 1, row, col, z00, row + 1, col + 1, z11, row + 1, col, z10 FROM q),
n AS (SELECT *, (br - ar) * 30 * (cz - az) - (bz - az) * (cr - ar) * 30 AS nx, (bz - az) * (cc - ac) * 30 - (bc - ac) * 30 * (cz - az) AS ny, ((bc - ac) * (cr - ar) - (br - ar) * (cc - ac)) * 900::DOUBLE AS nz FROM t),
k AS (SELECT ar AS r, ac AS c, nx, ny, nz FROM n UNION ALL SELECT br, bc, nx, ny, nz FROM n UNION ALL SELECT cr, cc, nx, ny, nz FROM n),
v AS (SELECT r, c, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM k GROUP BY ALL)"""


def _mesh(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mesh.grid_mesh(views.seabed(spark, sf_dir), 30.0)


def _placed(found: DataFrame, vertices: DataFrame) -> DataFrame:
    """With row and col in place of the vertex number."""
    at = vertices.select("vid", F.floor(F.col("y") / 30).alias("row"), F.floor(F.col("x") / 30).alias("col"))
    return found.join(at, "vid").drop("vid", "mesh_id")


@query("seabed", f"{SQUARES} SELECT count(*) AS faces, round(sum(sqrt(nx * nx + ny * ny + nz * nz)) / 2, 2) AS area FROM n")
def surface_mesh_area(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    return _rounded(mesh.face_areas(f, v).agg(F.count(F.lit(1)).alias("faces"), F.sum("area").alias("area")), 2)


@query("seabed", f"""{SQUARES}, e AS (SELECT least((ar, ac), (br, bc)) AS lo, greatest((ar, ac), (br, bc)) AS hi FROM t UNION ALL SELECT least((br, bc), (cr, cc)), greatest((br, bc), (cr, cc)) FROM t
UNION ALL SELECT least((ar, ac), (cr, cc)), greatest((ar, ac), (cr, cc)) FROM t), g AS (SELECT lo, hi, count(*) AS n FROM e GROUP BY ALL)
SELECT count(*) FILTER (n = 1) AS border, count(*) AS edges FROM g""")
def surface_mesh_edges(spark, sf_dir):
    f = _mesh(spark, sf_dir)[1]
    return mesh.edges(f).agg(F.count_if(F.col("faces") == 1).alias("border"), F.count(F.lit(1)).alias("edges"))


@query("seabed", f"{SQUARES} SELECT r AS row, c AS col, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) AS nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) AS ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) AS nz FROM v")
def vertex_normals(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    return _rounded(_placed(mesh.vertex_normals(f, v), v).select("row", "col", "nx", "ny", "nz"))


@query("seabed", f"""{SQUARES}, l AS (SELECT sqrt(.25 + .25 + .7071 ** 2) AS s)
SELECT r AS row, c AS col, round(.38 + .62 * greatest(0, least(1, (-.5 / s * nx + .5 / s * ny + .7071 / s * nz) / sqrt(nx * nx + ny * ny + nz * nz))), 6) AS shade FROM v, l""")
def hillshade(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    size = sum(c * c for c in display.LIGHT) ** 0.5
    found = mesh.vertex_shade(f, v, tuple(c / size for c in display.LIGHT), display.AMBIENT)
    return _rounded(_placed(found, v).select("row", "col", "shade"))


@query("seabed", "SELECT 0 AS mesh_id, (min(col) + .5) * 30::DOUBLE AS x_min, (max(col) + .5) * 30::DOUBLE AS x_max, (min(row) + .5) * 30::DOUBLE AS y_min, (max(row) + .5) * 30::DOUBLE AS y_max, min(z) AS z_min, max(z) AS z_max FROM seabed")
def mesh_box(spark, sf_dir):
    return mesh.bbox(_mesh(spark, sf_dir)[0])


@query("seabed", f"""{SQUARES}, e AS (SELECT DISTINCT least((ar, ac), (br, bc)) AS lo, greatest((ar, ac), (br, bc)) AS hi FROM t UNION SELECT least((br, bc), (cr, cc)), greatest((br, bc), (cr, cc)) FROM t
UNION SELECT least((ar, ac), (cr, cc)), greatest((ar, ac), (cr, cc)) FROM t), x AS (SELECT lo AS a, hi AS b FROM e UNION ALL SELECT hi, lo FROM e),
b AS (SELECT lo, hi FROM (SELECT least((ar, ac), (br, bc)) AS lo, greatest((ar, ac), (br, bc)) AS hi FROM t UNION ALL SELECT least((br, bc), (cr, cc)), greatest((br, bc), (cr, cc)) FROM t
UNION ALL SELECT least((ar, ac), (cr, cc)), greatest((ar, ac), (cr, cc)) FROM t) GROUP BY ALL HAVING count(*) = 1), f AS (SELECT lo AS p FROM b UNION SELECT hi FROM b),
w AS (SELECT (row, col) AS p, z FROM seabed), s1 AS (SELECT w.p, any_value(w.z) + CASE WHEN w.p IN (SELECT p FROM f) THEN 0 ELSE .5 END * (coalesce(avg(o.z), any_value(w.z)) - any_value(w.z)) AS z FROM w LEFT JOIN x ON x.a = w.p LEFT JOIN w o ON o.p = x.b GROUP BY w.p),
s2 AS (SELECT w.p, any_value(w.z) - CASE WHEN w.p IN (SELECT p FROM f) THEN 0 ELSE .53 END * (coalesce(avg(o.z), any_value(w.z)) - any_value(w.z)) AS z FROM s1 w LEFT JOIN x ON x.a = w.p LEFT JOIN s1 o ON o.p = x.b GROUP BY w.p)
SELECT p[1] AS row, p[2] AS col, round(z, 9) AS z FROM s2""")
def taubin_once(spark, sf_dir):
    """One round of smoothing; x and y of inner vertices of a grid stay where they are unless a neighbour is missing."""
    v, f = _mesh(spark, sf_dir)
    smooth = mesh.taubin_smooth(v, f, 1).select("mesh_id", "vid", F.col("z").alias("new"))
    return _rounded(_placed(smooth, v).select("row", "col", F.col("new").alias("z")), 9)


@query("seabed", f"""{SQUARES}, d AS (SELECT row, col, floor((col + .5) * 30 / 90)::BIGINT AS vx, floor((row + .5) * 30 / 90)::BIGINT AS vy, floor(z / 90)::BIGINT AS vz, z FROM seabed)
SELECT count(*) AS vertices, round(sum(z), 4) AS total FROM (SELECT avg(z) AS z FROM d GROUP BY vx, vy, vz)""")
def decimated_vertices(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    return _rounded(mesh.decimate(v, f, 90.0)[0].agg(F.count(F.lit(1)).alias("vertices"), F.sum("z").alias("total")), 4)


@query("seabed", f"""{SQUARES}, d AS (SELECT row, col, (floor((col + .5) * 30 / 90)::BIGINT, floor((row + .5) * 30 / 90)::BIGINT, floor(z / 90)::BIGINT) AS v FROM seabed),
m AS (SELECT a.v AS a, b.v AS b, c.v AS c FROM t JOIN d a ON a.row = ar AND a.col = ac JOIN d b ON b.row = br AND b.col = bc JOIN d c ON c.row = cr AND c.col = cc)
SELECT count(DISTINCT list_sort([a, b, c])) AS faces FROM m WHERE a <> b AND b <> c AND a <> c""")
def decimated_faces(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    return mesh.decimate(v, f, 90.0)[1].agg(F.count(F.lit(1)).alias("faces"))


@query("seabed", f"{SQUARES} SELECT m AS mesh_id, count(*) AS faces FROM n, range(2) u(m) GROUP BY m")
def merged_meshes(spark, sf_dir):
    one = _mesh(spark, sf_dir)
    return mesh.merge([one, one])[1].groupBy("mesh_id").agg(F.count(F.lit(1)).alias("faces"))


# A triangle's plane at the centres of cells half as wide as the mesh's: on its corners, the middle of its long side and its legs.
@query("seabed", f"{SQUARES}, r AS (SELECT row, col, z FROM seabed WHERE (row, col) IN (SELECT (r, c) FROM v)) SELECT row, col, round(z, 9) AS z FROM r")
def rasterized_mesh(spark, sf_dir):
    """A surface's mesh, rasterised at the surface's own cells, gives its heights again."""
    v, f = _mesh(spark, sf_dir)
    return _rounded(mesh.rasterize(f, v, 30.0), 9)


# ---- reports of routes --------------------------------------------------------------------------------------------------

GAPS = "g AS (SELECT *, z - 40 AS dob, coalesce((lag(ch) OVER w + ch) / 2, ch) AS lo, coalesce((lead(ch) OVER w + ch) / 2, ch) AS hi FROM profile WINDOW w AS (PARTITION BY route_id ORDER BY ch))"


def _stationed(spark, sf_dir: str) -> DataFrame:
    return views.profile(spark, sf_dir).select("route_id", "ch", F.col("z").alias("seabed"), F.lit(40.0).alias("top"))


def _stretch(name: str, mask: str) -> str:
    return f"""SELECT route_id, '{name}' AS type, round(min(lo), 6) AS ch_from, round(max(hi), 6) AS ch_to, round(sum(hi - lo), 6) AS length, round(min(dob), 6) AS worst, round(arg_min(ch, (dob, ch)), 6) AS ch_worst
FROM (SELECT *, sum(turn) OVER (PARTITION BY route_id ORDER BY ch) AS run FROM (SELECT *, {mask} AS flag, coalesce((({mask}) <> lag({mask}) OVER (PARTITION BY route_id ORDER BY ch))::INT, 1) AS turn FROM g)) WHERE flag GROUP BY route_id, run"""


@query("profile", f"{GAPS} {_stretch('Exposed', 'dob <= 1e-4')} UNION ALL {_stretch('Below target', 'dob < 15 - 1e-4')}")
def burial_stretches(spark, sf_dir):
    return _rounded(routes.burial_report(_stationed(spark, sf_dir), 15.0, 72.0)["Stretches"])


@query("profile", f"""{GAPS}, k AS (SELECT *, CASE WHEN point_id % 7 <> 0 THEN dob END AS d FROM g)
SELECT route_id, round(sum(hi - lo), 6) AS length, round(CASE WHEN sum(hi - lo) > 0 THEN coalesce(sum(hi - lo) FILTER (d IS NOT NULL), 0) / sum(hi - lo) * 100 END, 6) AS coverage_pct,
round(CASE WHEN coalesce(sum(hi - lo) FILTER (d IS NOT NULL), 0) > 0 THEN coalesce(sum(hi - lo) FILTER (d >= 15 - 1e-4), 0) / sum(hi - lo) FILTER (d IS NOT NULL) * 100 END, 6) AS compliant_pct,
round(coalesce(sum(hi - lo) FILTER (d < 15 - 1e-4 AND d > 1e-4), 0), 6) AS below, round(coalesce(sum(hi - lo) FILTER (d <= 1e-4), 0), 6) AS exposed,
round(min(d), 6) AS dob_min, round(arg_min(ch, (d, ch)) FILTER (d IS NOT NULL), 6) AS ch_min, round(avg(d), 6) AS dob_mean FROM k GROUP BY 1""")
def burial_summary(spark, sf_dir):
    rows = views.profile(spark, sf_dir).select("route_id", "ch", F.when(F.col("point_id") % 7 != 0, F.col("z")).alias("seabed"), F.lit(40.0).alias("top"))
    return _rounded(routes.burial_summary(rows, 15.0))


@query("profile", f"""{GAPS} SELECT route_id, floor(ch / 72 + 1e-9)::BIGINT AS bin, round(sum(hi - lo), 6) AS length, round(min(dob), 6) AS least, round(avg(dob), 6) AS mean, round(max(dob), 6) AS most,
round(sum(CASE WHEN dob >= 15 - 1e-4 THEN hi - lo ELSE 0 END) / sum(hi - lo) * 100, 6) AS ok_pct FROM g GROUP BY ALL""")
def burial_bins(spark, sf_dir):
    return _rounded(routes.burial_report(_stationed(spark, sf_dir), 15.0, 72.0)["Bins"])


@query("route_vertex", "SELECT route_id, 5.0::DOUBLE AS kp_from, round(5 + max(cum) / 1000, 8) AS kp_to FROM route_vertex GROUP BY 1")
def route_kp_range(spark, sf_dir):
    return _rounded(routes.kp_range(routes.with_kp(views.route_vertex(spark, sf_dir), 5.0)), 8)


@query("route_vertex", """e AS (SELECT route_id, max(cum) AS length FROM route_vertex GROUP BY 1)
SELECT route_id, 200.0::DOUBLE AS ch_from, round(least(length, 700), 5) AS ch_to FROM e WHERE length / 1000 + 5 >= 5.2 - 1e-9""")
def route_chainage_range(spark, sf_dir):
    found = routes.chainage_range(routes.with_kp(views.route_vertex(spark, sf_dir), 5.0), 5.7, 5.2)
    return _rounded(found, 5)


@query("route_vertex", """d AS (SELECT route_id, seq, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM route_vertex WINDOW w AS (PARTITION BY route_id ORDER BY seq))
SELECT route_id, seq, round(dx / greatest(sqrt(dx * dx + dy * dy), 1e-12), 6) AS ux, round(dy / greatest(sqrt(dx * dx + dy * dy), 1e-12), 6) AS uy FROM d WHERE dx IS NOT NULL""")
def route_directions(spark, sf_dir):
    found = routes.directions(views.route_vertex(spark, sf_dir))
    return _rounded(found.withColumn("seq", F.col("seq").cast("long")))


@query("route_vertex", "SELECT 'km' AS unit UNION ALL SELECT 'm'")
def route_kp_units(spark, sf_dir):
    v = views.route_vertex(spark, sf_dir)
    return routes.kp_unit(routes.with_kp(v)).union(routes.kp_unit(v.withColumn("kp", F.col("cum"))))


@query("structures", "SELECT name, round(x / 1000 + 121, 6) AS x, round(y / 100 + 25, 6) AS y FROM structures")
def places_reprojected(spark, sf_dir):
    s = views.structures(spark, sf_dir).withColumns({"x": F.col("x") / 1000 + 121, "y": F.col("y") / 100 + 25})
    there = saved(routes.reprojected(s, 4326, 32651))
    return _rounded(routes.reprojected(there, 32651, 4326).select("name", "x", "y"))


BATCH = """yr AS (SELECT route_id, ch, y AS year, z / 20 - (y - 2024) * .6 AS dob FROM profile, range(2024, 2027) t(y)),
g AS (SELECT *, coalesce((lead(ch) OVER w + ch) / 2, ch) - coalesce((lag(ch) OVER w + ch) / 2, ch) AS step FROM yr WINDOW w AS (PARTITION BY route_id, year ORDER BY ch)),
t AS (SELECT route_id, year, sum(step) AS length, sum(CASE WHEN dob < 1 - 1e-4 THEN step ELSE 0 END) AS below_m, sum(CASE WHEN dob <= 1e-4 THEN step ELSE 0 END) AS exposed_m, min(dob) AS dob_min FROM g GROUP BY ALL)"""


def _batch(spark, sf_dir: str) -> dict[str, DataFrame]:
    p = views.profile(spark, sf_dir).withColumn("year", F.explode(F.array(*[F.lit(y) for y in (2024, 2025, 2026)])))
    rows = p.select("route_id", "ch", "year", (F.col("z") / 20 - (F.col("year") - 2024) * 0.6).alias("dob"))
    return routes.multiyear_batch(rows, 1.0, 1.5, 20.0, 5.0)


@query("profile", f"{BATCH} SELECT route_id, year::INT AS year, round(length, 5) AS length, round(below_m, 5) AS below_m, round(exposed_m, 5) AS exposed_m, round(dob_min, 5) AS dob_min FROM t")
def multiyear_table(spark, sf_dir):
    return _rounded(_batch(spark, sf_dir)["Years"], 5)


@query("profile", f"""{BATCH} SELECT route_id, round(max(length), 5) AS length, '2024-2026' AS years, coalesce(min(year) FILTER (below_m > 0), 0)::INT AS first_reburial, coalesce(min(year) FILTER (exposed_m > 0), 0)::INT AS first_exposed,
arg_max(year, (below_m, -year))::INT AS worst_year, round(max(below_m), 5) AS worst_m FROM t GROUP BY 1""")
def multiyear_summary(spark, sf_dir):
    return _rounded(_batch(spark, sf_dir)["Summary"].fillna(0, ["first_reburial", "first_exposed"]), 5)
