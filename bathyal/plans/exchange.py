"""Queries that write tables in a format and read them back; their oracles say what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bathyal.operators import grid, mesh
from bathyal.operators.graph import passing_folder, saved
from bathyal.plans.registry import query
from bathyal.sinks import writers
from bathyal.sources import grids, las, text, vector, views


@query("pts", "SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, intensity::DOUBLE AS intensity FROM pts")
def text_round_trip(spark, sf_dir):
    """Delimited text with a header in every part file."""
    path = passing_folder(spark, "exchange")
    writers.export(views.pts(spark, sf_dir), path, "csv", columns=["x", "y", "z", "intensity"], decimals=6)
    lines = text.read_preview(spark, path, 50)
    delimiter = text.detect_delimiter(lines)
    start = text.detect_start_row(lines, delimiter)
    return text.read_xyz(spark, path, start, delimiter, ["X", "Y", "Z", "Intensity"]).select("x", "y", "z", "intensity")


@query("pts", "SELECT round(x, 2) AS x, round(-z, 2) AS depth, classification::DOUBLE AS classification FROM pts")
def text_depth_round_trip(spark, sf_dir):
    """Depths, positive down, turn into heights on reading."""
    path = passing_folder(spark, "exchange")
    writers.write_text(views.pts(spark, sf_dir), path, ["x", "y", "z", "classification"], "\t", 2, False, z_as_depth=True)
    back = text.read_xyz(spark, path, 0, "tab", ["X", "Y", "Z", "Classification"], z_is_depth=True)
    return back.select("x", F.round(-F.col("z"), 2).alias("depth"), "classification")


@query("pts", "SELECT round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, intensity, classification FROM pts")
def las_round_trip(spark, sf_dir):
    path = passing_folder(spark, "exchange")
    writers.export(views.pts(spark, sf_dir).repartition(3), path, "las")
    back = spark.read.format("las").load(path)
    return back.select(*[F.round(c, 3).alias(c) for c in ("x", "y", "z")], "intensity", "classification")


@query("pts", "SELECT count(*) AS n, min(classification) + 60 AS least, max(classification) + 60 AS most, sum(intensity)::BIGINT AS total FROM pts")
def las_large_classes(spark, sf_dir):
    """Classes above 31 need a newer point format."""
    las.register(spark)
    path = passing_folder(spark, "exchange")
    writers.export(views.pts(spark, sf_dir).withColumn("classification", F.col("classification") + 60), path, "las")
    back = spark.read.format("las").load(path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.min("classification").alias("least"), F.max("classification").alias("most"), F.sum("intensity").alias("total"))


DEM = "d AS (SELECT floor(y / 24)::BIGINT AS r, floor(x / 24)::BIGINT AS c, max(z) AS z FROM pts GROUP BY ALL)"


def _dem(spark, sf_dir: str) -> DataFrame:
    return grid.build_dem(views.pts(spark, sf_dir), 24.0, "max")


@query("pts", f"{DEM} SELECT (SELECT max(r) FROM d) - r AS row, c - (SELECT min(c) FROM d) AS col, (c + .5) * 24::DOUBLE AS x, (r + .5) * 24::DOUBLE AS y, round(z, 2) AS z FROM d")
def ascii_grid_round_trip(spark, sf_dir):
    path = passing_folder(spark, "exchange")
    writers.write_ascii_grid(_dem(spark, sf_dir), path, 24.0)
    return grids.read_ascii_grid(spark, path).withColumn("z", F.round("z", 2))


@query("pts", f"{DEM} SELECT (SELECT max(r) FROM d) - r AS row, c - (SELECT min(c) FROM d) AS col, round(z, 2) AS z, 24.0::DOUBLE AS cell FROM d")
def xyz_grid_round_trip(spark, sf_dir):
    path = passing_folder(spark, "exchange")
    writers.write_xyz_grid(_dem(spark, sf_dir), path, 24.0)
    back = grids.read_xyz_grid(text.read_xyz(spark, path, 0, "space", ["X", "Y", "Z"]))
    return back.select("row", "col", F.round("z", 2).alias("z"), "cell")


@query("pts", f"""{DEM}, b AS (SELECT point_id, x, y, floor(x / 24 - .5)::BIGINT AS c0, floor(y / 24 - .5)::BIGINT AS r0, x / 24 - .5 - floor(x / 24 - .5) AS fx, y / 24 - .5 - floor(y / 24 - .5) AS fy FROM pts),
k AS (SELECT point_id, r0 + dr AS r, c0 + dc AS c, (CASE dc WHEN 0 THEN 1 - fx ELSE fx END) * (CASE dr WHEN 0 THEN 1 - fy ELSE fy END) AS w FROM b, range(0, 2) t(dr), range(0, 2) u(dc))
SELECT point_id, round(sum(w * z) / sum(w), 6) AS value FROM k JOIN d USING (r, c) GROUP BY point_id HAVING sum(w) > 1e-12""")
def raster_sample(spark, sf_dir):
    """Bilinear samples of a raster whose lower left corner isn't the origin."""
    cells = _dem(spark, sf_dir).withColumns({"row": F.col("row") + 2, "col": F.col("col") + 5})
    found = grids.sample(views.pts(spark, sf_dir), cells, -5 * 24.0, -2 * 24.0, 24.0)
    return found.where("ref is not null").select("point_id", F.round("ref", 6).alias("value"))


def _points(spark, sf_dir: str) -> DataFrame:
    s = views.structures(spark, sf_dir)
    place = F.struct("x", "y", F.col("diameter").alias("z"))
    return s.select(F.lit("Point").alias("type"), F.array(F.array(place)).alias("parts"), F.create_map(F.lit("name"), F.col("name")).alias("attrs"))


def _features(spark, sf_dir: str) -> DataFrame:
    """Structures as points, routes as lines (those of ten vertices or more) and squares around structures as polygons."""
    v = views.route_vertex(spark, sf_dir)
    vertices = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    line = F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(None).cast("double").alias("z")))
    lines = v.groupBy("route_id").agg(vertices.alias("v")).where(F.size("v") >= 10)
    lines = lines.select(F.lit("LineString").alias("type"), F.array(line).alias("parts"), F.create_map(F.lit("name"), F.concat(F.lit("r"), F.col("route_id").cast("string"))).alias("attrs"))
    s = views.structures(spark, sf_dir)
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(None).cast("double").alias("z"))
    ring = lambda r: F.array(corner(-r, -r), corner(r, -r), corner(r, r), corner(-r, r), corner(-r, -r))
    polygons = s.select(F.lit("Polygon").alias("type"), F.array(ring(4.0), ring(1.0)).alias("parts"), F.create_map(F.lit("name"), F.col("name")).alias("attrs"))
    return _points(spark, sf_dir).unionByName(lines).unionByName(polygons)


FEATURES = """v AS (SELECT 'Point' AS type, name, x, y FROM structures UNION ALL
SELECT 'LineString', 'r' || route_id, x, y FROM route_vertex WHERE route_id IN (SELECT route_id FROM route_vertex GROUP BY 1 HAVING count(*) >= 10) UNION ALL
SELECT 'Polygon', name, x + r * dx, y + r * dy FROM structures, (VALUES (4.0), (1.0)) t(r), (VALUES (-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)) u(dx, dy))"""
PER_FEATURE = "SELECT type, name, count(*) AS vertices, round(sum(x), 4)::DOUBLE AS sum_x, round(sum(y), 4)::DOUBLE AS sum_y FROM v"


def _per_feature(features: DataFrame, name: str = "name") -> DataFrame:
    p = features.select("type", F.try_element_at("attrs", F.lit(name)).alias("name"), F.explode(F.flatten("parts")).alias("p"))
    return p.groupBy("type", "name").agg(F.count(F.lit(1)).alias("vertices"), F.round(F.sum("p.x"), 4).alias("sum_x"), F.round(F.sum("p.y"), 4).alias("sum_y"))


@query("structures route_vertex", f"{FEATURES} {PER_FEATURE} GROUP BY ALL")
def geojson_round_trip(spark, sf_dir):
    path = passing_folder(spark, "exchange")
    writers.write_geojson(_features(spark, sf_dir), path)
    lines = spark.read.text(path)
    collection = lines.groupBy(F.pmod(F.xxhash64("value"), F.lit(8))).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    collection.select("value").repartition(8).write.text(f"{path}-collections")
    return _per_feature(vector.read_geojson(spark, f"{path}-collections"))


@query("structures route_vertex", f"{FEATURES} {PER_FEATURE} GROUP BY ALL")
def kml_round_trip(spark, sf_dir):
    path = passing_folder(spark, "exchange")
    writers.write_kml(_features(spark, sf_dir), path)
    return _per_feature(vector.read_files(spark, path, "kml"))


@query("structures route_vertex", f"""{FEATURES}, c AS (SELECT type, name, count(*) AS n FROM v GROUP BY ALL)
SELECT 'Point' AS type, (SELECT count(*) FROM structures) AS n, (SELECT count(*) FROM structures) AS vertices UNION ALL
SELECT 'LineString', count(*), sum(n)::BIGINT FROM c WHERE type = 'LineString' UNION ALL SELECT 'Polygon', 2 * count(*), (10 * count(*))::BIGINT FROM structures""")
def dxf_round_trip(spark, sf_dir):
    """Each ring of a polygon is a closed polyline of its own."""
    path = passing_folder(spark, "exchange")
    writers.write_vector_dxf(_features(spark, sf_dir), path, "name")
    back = vector.read_files(spark, path, "dxf").withColumn("vertices", F.size(F.flatten("parts")))
    return back.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("vertices").alias("vertices"))


@query("structures route_vertex", f"{FEATURES}, c AS (SELECT DISTINCT type, name FROM v) SELECT type, count(*) AS n FROM c GROUP BY type")
def vector_counts(spark, sf_dir):
    return vector.counts(_features(spark, sf_dir))


@query("structures route_vertex", f"{FEATURES} SELECT min(x)::DOUBLE AS x1, min(y)::DOUBLE AS y1, max(x)::DOUBLE AS x2, max(y)::DOUBLE AS y2 FROM v")
def vector_bounds(spark, sf_dir):
    return vector.bounds(_features(spark, sf_dir))


@query("route_vertex", "SELECT 'r' || route_id AS route_id, (seq - 1)::INT AS seq, x, y FROM route_vertex WHERE route_id IN (SELECT route_id FROM route_vertex GROUP BY 1 HAVING count(*) >= 10)")
def routes_of_features(spark, sf_dir):
    found = vector.routes_from_features(_features(spark, sf_dir))
    return found.select("route_id", F.col("seq").cast("int").alias("seq"), "x", "y")


@query("route_vertex", "SELECT route_id::VARCHAR AS route_id, round(x, 4) AS x, round(cum / 1000, 7) AS kp, round(-y / 100 + 3 + .1, 6) AS z FROM route_vertex")
def route_table(spark, sf_dir):
    """Chainage in metres, burial depths in centimetres of the cable's centre, a decimal comma, semicolons."""
    path = passing_folder(spark, "exchange")
    comma = lambda c, f: F.regexp_replace(F.format_string(f, c), r"\.", ",")
    v = views.route_vertex(spark, sf_dir)
    rows = v.select(F.concat_ws(";", F.col("route_id").cast("string"), comma(F.col("x"), "%.9f"), comma(F.col("y"), "%.9f"), comma(F.col("cum"), "%.9f")).alias("value"))
    rows.write.text(path)
    level = {"unit": "cm", "is_depth": True, "offset": 3.0, "diameter": 0.2, "reference": "centre"}
    back = text.read_route_table(spark, path, "semicolon", {"route": 0, "x": 1, "z": 2, "y": 2, "kp": 3}, decimal_comma=True, kp_unit="m", level=level)
    return back.select("route_id", F.round("x", 4).alias("x"), F.round("kp", 7).alias("kp"), F.round("z", 6).alias("z"))


@query("structures", "SELECT name, x, y, CASE WHEN y > 10 THEN 5.5 ELSE 8 END::DOUBLE AS diameter FROM structures")
def structure_table(spark, sf_dir):
    """Diameters of 0 become the default."""
    path = passing_folder(spark, "exchange")
    s = views.structures(spark, sf_dir).withColumn("diameter", F.when(F.col("y") > 10, 5.5).otherwise(0.0))
    s.select("name", "x", "y", "diameter").write.csv(path)
    return text.read_structures(spark, path, "comma", {"name": 0, "x": 1, "y": 2, "diameter": 3})


@query("pts", "SELECT count(*) AS n, round(sum(v1), 4) AS v1, round(sum(v2), 4) AS v2 FROM (SELECT z AS v1, intensity::DOUBLE AS v2 FROM pts WHERE point_id % 10 <> 0)")
def value_table(spark, sf_dir):
    """Rows in which any value isn't a number are left out."""
    path = passing_folder(spark, "exchange")
    odd = F.when(F.col("point_id") % 10 == 0, F.lit("n/a")).otherwise(F.col("intensity").cast("string"))
    views.pts(spark, sf_dir).select("x", "y", "z", odd.alias("i")).write.option("header", True).csv(path)
    back = text.read_value_table(spark, path, "comma", values=(2, 3))
    return back.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v1"), 4).alias("v1"), F.round(F.sum("v2"), 4).alias("v2"))


TURN = """c AS (SELECT name AS image, x, y, 100.0 AS z, radians(y) AS o, radians(-y / 2) AS p, radians(x) AS k FROM structures)"""


@query("structures", f"""{TURN} SELECT image, x, y, z::DOUBLE AS z, round(cos(p) * cos(k), 6) AS r11, round(cos(p) * sin(k), 6) AS r21, round(-sin(p), 6) AS r31, round(sin(o) * cos(p), 6) AS r32, round(-cos(o) * cos(p), 6) AS r33,
round(cos(o) * sin(k) + sin(o) * sin(p) * cos(k), 6) AS r12, 1200.0::DOUBLE AS f FROM c""")
def camera_table(spark, sf_dir):
    """Angles give the rotation from the world to a camera that looks ahead along z; written from that and read again."""
    path = passing_folder(spark, "exchange")
    s = views.structures(spark, sf_dir)
    rows = s.select(F.col("name").alias("Label"), F.col("x").alias("X/East"), F.col("y").alias("Northing"), F.lit(100.0).alias("Alt"), F.col("y").alias("Omega"), (-F.col("y") / 2).alias("phi_deg"), F.col("x").alias("KAPPA"), F.lit(1200.0).alias("f_px"))
    rows.coalesce(1).write.option("header", True).csv(path)
    first = text.read_cameras(spark, path)
    writers.write_cameras(first, f"{path}-again")
    back = text.read_cameras(spark, f"{path}-again")
    return back.select("image", "x", "y", "z", *[F.round(c, 6).alias(c) for c in ("r11", "r12", "r21", "r31", "r32", "r33")], "f")


@query("structures", "SELECT name AS image, x, y, 8.0::DOUBLE AS z FROM structures")
def feature_cameras(spark, sf_dir):
    return text.cameras_from_features(_features(spark, sf_dir))


@query("structures", "SELECT name AS image, 'g' || y::INT AS gcp, x AS px, y AS py FROM structures")
def gcp_observations(spark, sf_dir):
    path = passing_folder(spark, "exchange")
    s = views.structures(spark, sf_dir)
    rows = s.select(F.col("name").alias("image"), F.concat(F.lit("g"), F.col("y").cast("int").cast("string")).alias("gcp"), F.col("x").alias("px"), F.col("y").alias("py"))
    writers.write_gcp_observations(rows, path)
    return text.read_gcp_observations(spark, path)


@query("structures", "SELECT name, x, y, 8.0::DOUBLE AS z FROM structures")
def gcp_coordinates(spark, sf_dir):
    path = passing_folder(spark, "exchange")
    views.structures(spark, sf_dir).select("name", "x", "y", F.col("diameter").alias("z")).write.option("header", True).csv(path)
    return text.read_gcp_coordinates(spark, path)


@query("pts seabed", "SELECT 'points' AS dataset, count(*) AS n, round(sum(z), 4) AS total, 'EPSG:32651' AS crs FROM pts UNION ALL SELECT 'surface', count(*), round(sum(z), 4), 'EPSG:32651' FROM seabed")
def project_round_trip(spark, sf_dir):
    path = passing_folder(spark, "exchange")
    writers.save_project({"points": views.pts(spark, sf_dir), "surface": views.seabed(spark, sf_dir)}, path, {"crs": "EPSG:32651"})
    meta, sets = writers.load_project(spark, path)
    out = None
    for name, frame in sets.items():
        row = frame.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("total"), F.lit(meta["crs"]).alias("crs"))
        out = row if out is None else out.union(row)
    return out


@query("seabed", """s AS (SELECT a.row, a.col FROM seabed a JOIN seabed b ON b.row = a.row AND b.col = a.col + 1 JOIN seabed c ON c.row = a.row + 1 AND c.col = a.col JOIN seabed d ON d.row = a.row + 1 AND d.col = a.col + 1)
SELECT 'obj' AS kind, (SELECT count(*) FROM seabed) AS vertices, (SELECT 2 * count(*) FROM s) AS faces UNION ALL SELECT 'ply', (SELECT count(*) FROM seabed), (SELECT 2 * count(*) FROM s)
UNION ALL SELECT 'dxf', (SELECT 8 * count(*) FROM s), (SELECT 2 * count(*) FROM s) UNION ALL SELECT 'stl', (SELECT 6 * count(*) FROM s), (SELECT 2 * count(*) FROM s)""")
def mesh_files(spark, sf_dir):
    """What OBJ, PLY, DXF and STL files of a surface's mesh hold; DXF faces name four corners, STL faces three."""
    v, f = mesh.grid_mesh(saved(views.seabed(spark, sf_dir)), 30.0)
    v, f = saved(v), saved(f)  # every file takes them several times
    path = passing_folder(spark, "exchange")
    for kind in ("obj", "dxf"):
        writers.write_mesh(v, f, f"{path}/{kind}", kind)
    writers.write_ply(v, f, f"{path}/ply")
    writers.write_stl(v, f, f"{path}/stl")
    marks = {"obj": ("obj", r"^v ", r"^f "), "dxf": ("dxf", r"^1[0123]$", r"^3DFACE$"), "stl": ("stl", r"^ *vertex ", r"^ *facet ")}
    out = None
    for kind, (folder, vertex, face) in marks.items():
        row = spark.read.text(f"{path}/{folder}").agg(F.lit(kind).alias("kind"), F.count_if(F.col("value").rlike(vertex)).alias("vertices"), F.count_if(F.col("value").rlike(face)).alias("faces"))
        out = row if out is None else out.union(row)
    count = lambda part: spark.read.text(f"{path}/ply/{part}").agg(F.count(F.lit(1)))
    return out.union(count("1-vertices").select(F.lit("ply"), F.col("count(1)")).crossJoin(count("2-faces")))
