from __future__ import annotations

import struct
import tracemalloc

import pytest
from pyspark.sql import functions as F

from bathyal.operators import grid
from bathyal.sinks import writers
from bathyal.sources import grids, las, text, vector


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_encoding_and_shape_of_text():
    assert text.detect_encoding("x é 中".encode()) == "utf-8-sig"
    assert text.detect_encoding("中文資料".encode("cp950")) == "cp950"
    assert text.detect_encoding(b"\xe9\xff\xfe caf\xe9 ok ok ok") == "latin-1"
    assert text.detect_encoding(("a" * 5 + "é").encode()[:-1]) == "utf-8-sig"
    lines = ["# notes", "E N Z", "1,2,3,9", "2,3,4,9", "3,4,5,9"]
    assert text.detect_delimiter(lines) == "comma" and text.detect_start_row(lines, "comma") == 2
    assert text.guess_roles([[1, 2, 3, 4]])[-1] == "Intensity"
    assert text.guess_roles([[1, 2, 3, 10, 20, 30]])[3:] == ["R", "G", "B"]
    assert text.guess_roles([[1, 2, 3, 0.5, 20, 30]])[3:] == ["Custom"] * 3
    assert text.validate_roles(["X", "Y"]) and not text.validate_roles(["X", "Y", "Z", "Custom", "Custom"])


def test_read_xyz(spark, tmp_path):
    path = write(tmp_path, "a.txt", "E N D I\n1 2 3 7\nbad x 1 1\n4 5 6 n/a\n\n7 8\n")
    got = text.read_xyz(spark, path, 1, "space", ["X", "Y", "Z", "Custom"], z_is_depth=True).orderBy("x").collect()
    assert [(r.x, r.y, r.z, r.col_4) for r in got] == [(1, 2, -3, 7), (4, 5, -6, None)]


def test_angles_and_cable_levels(spark):
    rows = spark.createDataFrame([("23°30'00\"N",), ("120 15 36 W",), ("-1.5",), ("x",)], "t string")
    got = [r[0] for r in rows.select(text.parse_angle(F.col("t"))).collect()]
    assert got[:3] == pytest.approx([23.5, -120.26, -1.5]) and got[3] is None
    level = spark.range(1).select(text.cable_level(F.lit(2150.0), "cm", True, 0.0, 0.2, "centre")).first()[0]
    assert level == pytest.approx(-21.4)


def test_route_table(spark, tmp_path):
    path = write(tmp_path, "r.csv", "KP;Lat;Lon;TOC\n# survey\n0,0;23°30'00\"N;119°E;2140\n1,5;23,6;119,1;2150\n")
    columns = {"kp": 0, "y": 1, "x": 2, "z": 3}
    got = text.read_route_table(spark, path, "semicolon", columns, 1, True, level={"unit": "cm", "is_depth": True}).collect()
    assert [(r.kp, r.y, round(r.z, 2)) for r in got] == [(1.5, 23.6, -21.5)]
    both = text.read_route_table(spark, path, "semicolon", columns, 1, True, angles=True).orderBy("seq").collect()
    assert both[0].y == pytest.approx(23.5) and len(both) == 2


def test_structures_and_cameras(spark, tmp_path):
    path = write(tmp_path, "s.csv", "name,x,y,d\nA,1,2,0\n,3,4,6\n")
    got = text.read_structures(spark, path, "comma", {"name": 0, "x": 1, "y": 2, "diameter": 3}, 1).orderBy("x").collect()
    assert [(r.name, r.diameter) for r in got] == [("A", 8.0), ("S02", 6.0)]
    cams = write(tmp_path, "c.csv", "Label,Easting,Northing,Altitude,Omega,Phi,Kappa,F\nim1,1,2,3,0,0,90,50\n")
    c = text.read_cameras(spark, cams).first()
    assert c.x == 1 and c.f is None and c.r12 == pytest.approx(1) and c.r33 == pytest.approx(-1)  # a camera without tilt looks down
    cams = write(tmp_path, "d.csv", "img;X/East;Y/North;Z/Alt;omega_deg;phi_deg;kappa_deg;f_px;height_px\nim1;1;2;3;0;90;0;50;7\n")
    c = text.read_cameras(spark, cams).first()
    assert (c.image, c.y, c.f, c.h) == ("im1", 2, 50, 7) and c.r31 == pytest.approx(-1) and c.r33 == pytest.approx(0)


def test_lines_of_a_file_in_many_splits_are_numbered(spark, tmp_path):
    """Each split counts from its file's start, so a raster's rows stay one below the other."""
    rows = [" ".join(str(100 * r + c) for c in range(30)) for r in range(400)]
    path = write(tmp_path, "g.asc", "ncols 30\nnrows 400\nxllcorner 0\nyllcorner 0\ncellsize 2\nNODATA_value -9999\n" + "\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        got = grids.read_ascii_grid(spark, path).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 12000 and (got.z == 100 * got.row + got.col).all() and got.y.max() == 799


def test_ascii_grid_round_trip(spark, tmp_path):
    surface = spark.createDataFrame([(0, 0, 1.5), (0, 2, 2.5), (2, 1, -3.25)], "row long, col long, z double")
    writers.write_ascii_grid(surface, str(tmp_path / "g"), 2.0)
    back = grids.read_ascii_grid(spark, str(tmp_path / "g")).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.x, r.y, r.z) for r in back] == [(0, 1, 3, 5, -3.25), (2, 0, 1, 1, 1.5), (2, 2, 5, 1, 2.5)]


def test_xyz_grid(spark):
    rows = [(i, float(i % 4) * 0.5, float(i // 4) * 0.5, float(i)) for i in range(12)]
    got = grids.read_xyz_grid(spark.createDataFrame(rows, "point_id long, x double, y double, z double")).orderBy("row", "col").collect()
    assert got[0].cell == 0.5 and got[0].z == 8 and len(got) == 12


@pytest.mark.parametrize("cls", [2, 65])
def test_las_round_trip(spark, tmp_path, cls):
    las.register(spark)
    rows = spark.range(1000).select(
        (F.col("id") * 0.25).alias("x"), (-F.col("id")).cast("double").alias("y"), (F.col("id") / 8).alias("z"), (F.col("id") % 100).cast("int").alias("intensity"), F.lit(cls).alias("classification")
    )
    rows.coalesce(2).write.format("las").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("las").load(str(tmp_path / "out"))
    assert back.count() == 1000 and back.select("point_id").distinct().count() == 1000
    a = back.orderBy("x").select("x", "y", "z", "intensity", "classification").collect()
    b = rows.orderBy("x").collect()
    assert all(abs(p.x - q.x) < 1e-3 and abs(p.y - q.y) < 1e-3 and p[3:] == q[3:] for p, q in zip(a, b))


def test_geojson(spark, tmp_path):
    doc = """{"type":"FeatureCollection","features":[
    {"type":"Feature","properties":{"name":"a","n":1},"geometry":{"type":"Point","coordinates":[1,2,3]}},
    {"type":"Feature","properties":{},"geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,2],[3,3]]]}},
    {"type":"Feature","properties":null,"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]}}]}"""
    got = vector.read_geojson(spark, write(tmp_path, "f.geojson", doc))
    assert {r.type: r.n for r in vector.counts(got).collect()} == {"Point": 1, "LineString": 2, "Polygon": 1}
    assert tuple(vector.bounds(got).first()) == (0, 0, 4, 4)
    writers.write_geojson(got, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,2.0,3.0]},"properties":{"name":"a","n":"1"}}' in lines


def test_geojson_with_a_document_on_each_line(spark, tmp_path):
    point = '{"type":"Feature","properties":{"name":"%s"},"geometry":{"type":"Point","coordinates":[1,2]}}'
    docs = ['{"type":"FeatureCollection","features":[' + ",".join(point % n for n in names) + "]}" for names in ("ab", "c")]
    write(tmp_path, "lines.geojson", "\n".join([*docs, point % "d", ""]))
    write(tmp_path, "whole.geojson", docs[0].replace(",", ",\n"))
    got = vector.read_geojson(spark, str(tmp_path))
    assert sorted(r.attrs["name"] for r in got.collect()) == ["a", "a", "b", "b", "c", "d"]


def test_wkb(spark):
    point = struct.pack("<BI3d", 1, 1001, 1.0, 2.0, 3.0)
    line = struct.pack(">BII4d", 0, 2, 2, 0.0, 0.0, 1.0, 1.0)
    many = struct.pack("<BII", 1, 7, 2) + point + line
    rows = spark.createDataFrame([(1, bytearray(many)), (2, None)], "id int, g binary")
    got = vector.from_wkb(rows, "g").collect()
    assert [r.type for r in got] == ["Point", "LineString"] and got[0].parts[0][0].z == 3 and got[1].parts[0][1].x == 1


def test_xml_dxf_shp(spark, tmp_path):
    kml = '<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><name>p</name><LineString><coordinates>1,2,3 4,5,6</coordinates></LineString></Placemark></kml>'
    got = vector.read_files(spark, write(tmp_path, "a.kml", kml), "kml")
    assert [(r.route_id, r.seq, r.x, r.z) for r in vector.routes_from_features(got).orderBy("seq").collect()] == [("p", 0, 1, 3), ("p", 1, 4, 6)]
    gpx = '<gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1" lon="2"/><trk><trkseg><trkpt lat="1" lon="2"><ele>9</ele></trkpt><trkpt lat="3" lon="4"/></trkseg></trk></gpx>'
    got = vector.read_files(spark, write(tmp_path, "a.gpx", gpx), "gpx").collect()
    assert [r.type for r in got] == ["Point", "LineString"] and got[1].parts[0][0].z == 9
    dxf = "0\nSECTION\n2\nENTITIES\n0\nLINE\n8\nL1\n10\n0\n20\n0\n30\n1\n11\n5\n21\n6\n31\n2\n0\nLWPOLYLINE\n8\nL2\n70\n1\n10\n0\n20\n0\n10\n1\n20\n0\n10\n1\n20\n1\n0\nENDSEC\n0\nEOF\n"
    got = vector.read_files(spark, write(tmp_path, "a.dxf", dxf), "dxf").collect()
    assert [(r.type, r.attrs["layer"], len(r.parts[0])) for r in got] == [("LineString", "L1", 2), ("Polygon", "L2", 4)]
    outer, hole = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
    flat = [c for p in outer + hole for c in p]
    body = struct.pack("<I4d2I2I", 5, 0, 0, 4, 4, 2, 9, 0, 5) + struct.pack("<18d", *flat)
    shp = bytes(100) + struct.pack(">2I", 1, len(body) // 2) + body
    got = vector.read_files(spark, write(tmp_path, "a.shp", shp), "shp").collect()
    assert got[0].type == "Polygon" and [len(p) for p in got[0].parts] == [5, 4]


def test_text_sink_and_project(spark, tmp_path):
    points = spark.createDataFrame([(1, 1.0, 2.0, -3.5, 7)], "point_id long, x double, y double, z double, intensity int")
    writers.write_text(points.coalesce(1), str(tmp_path / "t"), ["x", "y", "z", "intensity"], ",", 2, True, z_as_depth=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["x,y,Depth,intensity", "1.00,2.00,3.50,7"]
    writers.save_project({"points": points, "grid": grid.build_dem(points, 1.0)}, str(tmp_path / "p"), {"crs": "EPSG:32651"})
    meta, sets = writers.load_project(spark, str(tmp_path / "p"))
    assert meta["crs"] == "EPSG:32651" and sets["points"].count() == 1 and meta["datasets"] == ["grid", "points"]


def test_shapefile_with_attributes(spark, tmp_path):
    def record(i, x, y):
        body = struct.pack("<I2d", 1, x, y)
        return struct.pack(">2I", i, len(body) // 2) + body

    write(tmp_path, "p.shp", bytes(100) + record(1, 1.0, 2.0) + record(2, 3.0, 4.0))
    field = lambda name, kind, size: name.encode().ljust(11, b"\0") + kind + bytes(4) + bytes([size, 0]) + bytes(14)
    heads = field("NAME", b"C", 6) + field("DEPTH", b"N", 5) + b"\r"
    rows = b" " + "bölt".encode().ljust(6) + b" 12.5" + b" " + b"b".ljust(6) + b"     "
    dbf = struct.pack("<B3BIHH", 3, 26, 1, 1, 2, 32 + len(heads), 12) + bytes(20) + heads + rows
    write(tmp_path, "p.dbf", dbf)
    got = {r.parts[0][0].x: r.attrs for r in vector.read_shp(spark, str(tmp_path)).collect()}
    assert got == {1.0: {"NAME": "bölt", "DEPTH": "12.5"}, 3.0: {"NAME": "b"}}


def test_geopackage(spark, tmp_path):
    import sqlite3

    path = tmp_path / "a.gpkg"
    base = sqlite3.connect(path)
    base.execute("create table gpkg_contents (table_name text, data_type text)")
    base.execute("create table gpkg_geometry_columns (table_name text, column_name text, srs_id int)")
    for layer in ("spots", "ways"):
        base.execute("insert into gpkg_contents values (?, 'features')", (layer,))
        base.execute("insert into gpkg_geometry_columns values (?, 'geom', 4326)", (layer,))
        base.execute(f"create table {layer} (fid int, geom blob, name text)")
    head = b"GP\0" + bytes([1]) + struct.pack("<i", 4326)
    boxed = b"GP\0" + bytes([3]) + struct.pack("<i4d", 4326, 0, 1, 0, 1)
    base.execute("insert into spots values (1, ?, 'a')", (head + struct.pack("<BI2d", 1, 1, 5.0, 6.0),))
    base.execute("insert into spots values (2, null, 'none')")
    base.execute("insert into ways values (1, ?, 'w')", (boxed + struct.pack("<BII4d", 1, 2, 2, 0.0, 0.0, 1.0, 1.0),))
    base.commit()
    base.close()
    assert [r.name for r in vector.layers(spark, str(path)).collect()] == ["spots", "ways"]
    first = vector.read_gpkg(spark, str(path)).collect()
    assert [(r.type, r.parts[0][0].x, r.attrs["name"]) for r in first] == [("Point", 5.0, "a")]
    ways = vector.read_gpkg(spark, str(path), "ways").collect()
    assert [(r.type, len(r.parts[0])) for r in ways] == [("LineString", 2)]


def test_dxf_is_read_without_a_copy_of_each_line():
    """Lines of a file are not held at once: three times the file is enough."""
    vertex = "0\nVERTEX\n8\na\n10\n1.5\n20\n2.5\n30\n0.0\n"
    content = ("0\nSECTION\n2\nENTITIES\n" + ("0\nPOLYLINE\n8\na\n66\n1\n70\n0\n" + vertex * 50 + "0\nSEQEND\n") * 500 + "0\nENDSEC\n0\nEOF\n").encode()
    tracemalloc.start()
    try:
        n = sum(len(parts[0]) for _, parts, _ in vector.FORMATS["dxf"](content))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 25_000 and peak < 3 * len(content)
