"""Writers. Each one is a projection to lines of text and Spark's text sink, or Parquet with a manifest written last."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def format_value(value: Column, kind: str, decimals: int | None = None) -> Column:
    """Whole numbers without a point, coordinates with fixed decimals, others with ten digits."""
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return value.cast("string")
    if decimals is not None:
        return F.format_string(f"%.{decimals}f", value)
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.regexp_replace(F.format_string("%.10f", value), r"0+$", ""))


def write_text(points: DataFrame, path: str, columns: list[str], delimiter: str = " ", decimals: int = 3, header: bool = True, z_as_depth: bool = False) -> None:
    kinds = dict(points.dtypes)
    value = lambda c: -F.col(c) if c == "z" and z_as_depth else F.col(c)
    texts = [F.coalesce(format_value(value(c), kinds[c], decimals if c in ("x", "y", "z") else None), F.lit("")).alias("Depth" if c == "z" and z_as_depth else c) for c in columns]
    points.select(*texts).write.option("sep", delimiter).option("header", header).option("quote", "").csv(path)


def write_xyz_grid(surface: DataFrame, path: str, cell: float, decimals: int = 3) -> None:
    """Cells that hold data: the chosen sounding's place if there is one, else the centre."""
    x, y = (F.col("col") + 0.5) * cell, (F.col("row") + 0.5) * cell
    if "tx" in surface.columns:
        x, y = F.coalesce("tx", x), F.coalesce("ty", y)
    write_text(surface.select(x.alias("x"), y.alias("y"), "z"), path, ["x", "y", "z"], decimals=decimals, header=False)


def ascii_grid_lines(surface: DataFrame, cell: float, nodata: float = -9999.0) -> DataFrame:
    """n and value: the lines of an ESRI ASCII grid in order; rows of the surface count from the south.

    A line is one row of cells, put together in its own group; rows without data are lines of no-data values.
    """
    box = surface.agg(*[f(c).alias(n) for f, c, n in ((F.min, "row", "r1"), (F.max, "row", "r2"), (F.min, "col", "c1"), (F.max, "col", "c2"))])
    b = box.first()
    width = b.c2 - b.c1 + 1
    cells = surface.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "z"))).alias("m"))
    rows = surface.sparkSession.range(b.r1, b.r2 + 1).toDF("row").join(cells, "row", "left")
    texts = F.transform(F.sequence(F.lit(b.c1), F.lit(b.c2)), lambda c: F.format_string("%.3f", F.coalesce(F.try_element_at("m", c), F.lit(nodata))))
    head = [f"ncols {width}", f"nrows {b.r2 - b.r1 + 1}", f"xllcorner {b.c1 * cell}", f"yllcorner {b.r1 * cell}", f"cellsize {cell}", f"NODATA_value {nodata:g}"]
    top = surface.sparkSession.createDataFrame(list(enumerate(head)), "n long, value string")
    return top.union(rows.select((F.lit(b.r2 + len(head)) - F.col("row")).alias("n"), F.array_join(texts, " ").alias("value")))


def write_ascii_grid(surface: DataFrame, path: str, cell: float) -> None:
    """One file in order; a surface too large for one file belongs in Parquet."""
    ascii_grid_lines(surface, cell).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)


def mesh_lines(vertices: DataFrame, faces: DataFrame, kind: str) -> DataFrame:
    """block, n and value: lines of an OBJ file (`obj`) or of DXF faces (`dxf`)."""
    from bathyal.operators.mesh import corners, numbered_vertices

    if kind == "dxf":
        point = lambda k, i: "\n".join(f"{c}{i}\n%.6f" for c in (1, 2, 3))
        names = [("a", 0), ("b", 1), ("c", 2), ("c", 3)]
        shape = "0\n3DFACE\n8\nTIN\n" + "\n".join(point(*k) for k in names)
        face = F.format_string(shape, *[F.col(f"{k}{x}") for k, _ in names for x in ("x", "y", "z")])
        return corners(faces, vertices).select(F.lit(1).alias("block"), F.col("fid").alias("n"), face.alias("value"))
    numbered = numbered_vertices(vertices)  # OBJ numbers all vertices
    lines = numbered.select(F.lit(0).alias("block"), "n", F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("value"))
    out = faces
    for k in ("a", "b", "c"):
        out = out.join(numbered.select("mesh_id", F.col("vid").alias(k), F.col("n").alias(f"n{k}")), ["mesh_id", k])
    return lines.union(out.select(F.lit(1), "fid", F.format_string("f %d %d %d", "na", "nb", "nc")))


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str, kind: str = "obj") -> None:
    """Part files whose lines follow one another from file to file; put together they are one OBJ or DXF file."""
    lines = mesh_lines(vertices, faces, kind)
    if kind == "dxf":
        wrap = lambda text, n: vertices.sparkSession.createDataFrame([(n, 0, text)], "block int, n long, value string")
        lines = wrap("0\nSECTION\n2\nENTITIES", -1).union(lines).union(wrap("0\nENDSEC\n0\nEOF", 9))
    lines.repartitionByRange("block", "n").sortWithinPartitions("block", "n").select("value").write.text(path)


def _triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Corners of each face and its unit normal (zero for faces without area)."""
    from bathyal.operators.mesh import _cross, corners

    x, y, z = _cross()
    size = F.sqrt(x * x + y * y + z * z)
    unit = lambda c: F.when(size > 0, c / size).otherwise(F.lit(0.0))
    return corners(faces, vertices).withColumns({"nx": unit(x), "ny": unit(y), "nz": unit(z)})


def write_stl(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """ASCII STL, one solid per part file; every face stands for itself, so parts can be written and read alone."""
    corner = "\n".join(["      vertex %.6f %.6f %.6f"] * 3)
    face = F.format_string(f"  facet normal %.6f %.6f %.6f\n    outer loop\n{corner}\n    endloop\n  endfacet", "nx", "ny", "nz", *[f"{k}{c}" for k in "abc" for c in "xyz"])
    _triangles(vertices, faces).select(face.alias("value")).write.option("lineSep", "\n").text(path)


def write_ply(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """ASCII PLY in three folders, head, vertices and faces, which follow one another in that order."""
    from bathyal.operators.mesh import numbered_vertices

    spark = vertices.sparkSession
    n = numbered_vertices(vertices)
    out = faces
    for k in ("a", "b", "c"):
        out = out.join(n.select("mesh_id", F.col("vid").alias(k), F.col("n").alias(f"n{k}")), ["mesh_id", k])
    text = ["ply", "format ascii 1.0", f"element vertex {vertices.count()}", *(f"property double {c}" for c in "xyz"), f"element face {faces.count()}", "property list uchar int vertex_indices", "end_header"]
    spark.createDataFrame([("\n".join(text),)], "value string").coalesce(1).write.text(f"{path}/0-head")
    n.select("n", F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("value")).repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(f"{path}/1-vertices")
    out.select(F.format_string("3 %d %d %d", F.col("na") - 1, F.col("nb") - 1, F.col("nc") - 1).alias("value")).write.text(f"{path}/2-faces")


def write_landxml(vertices: DataFrame, faces: DataFrame, path: str, name: str = "TIN") -> None:
    """A LandXML surface in five folders that follow one another: head, points (northing, easting, height), middle, faces, tail."""
    from bathyal.operators.mesh import numbered_vertices

    spark = vertices.sparkSession
    n = numbered_vertices(vertices)
    out = faces
    for k in ("a", "b", "c"):
        out = out.join(n.select("mesh_id", F.col("vid").alias(k), F.col("n").alias(f"n{k}")), ["mesh_id", k])
    units = '<Units><Metric areaUnit="squareMeter" linearUnit="meter" volumeUnit="cubicMeter" temperatureUnit="celsius" pressureUnit="milliBars"/></Units>'
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<LandXML xmlns="http://www.landxml.org/schema/LandXML-1.2" version="1.2">\n{units}\n<Surfaces><Surface name="{name}"><Definition surfType="TIN"><Pnts>'
    texts = {"0-head": head, "2-middle": "</Pnts><Faces>", "4-tail": "</Faces></Definition></Surface></Surfaces></LandXML>"}
    for folder, text in texts.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{folder}")
    point = F.format_string('<P id="%d">%.4f %.4f %.4f</P>', "n", "y", "x", "z")
    n.select("n", point.alias("value")).repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(f"{path}/1-points")
    out.select(F.format_string("<F>%d %d %d</F>", "na", "nb", "nc").alias("value")).write.text(f"{path}/3-faces")


def kml_placemarks(features: DataFrame, name: str = "name") -> DataFrame:
    """value: one Placemark per feature; coordinates are longitude, latitude and, if there is one, height."""
    point = lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"), p["z"].cast("string"))
    text = lambda part: F.concat(F.lit("<coordinates>"), F.array_join(F.transform(part, point), " "), F.lit("</coordinates>"))
    ring = lambda part: F.concat(F.lit("<LinearRing>"), text(part), F.lit("</LinearRing>"))
    inner = F.array_join(F.transform(F.slice("parts", 2, F.greatest(F.lit(0), F.size("parts") - 1)), lambda p: F.concat(F.lit("<innerBoundaryIs>"), ring(p), F.lit("</innerBoundaryIs>"))), "")
    first = F.col("parts")[0]
    shape = (
        F.when(F.col("type") == "Point", F.concat(F.lit("<Point>"), text(first), F.lit("</Point>")))
        .when(F.col("type") == "LineString", F.concat(F.lit("<LineString>"), text(first), F.lit("</LineString>")))
        .otherwise(F.concat(F.lit("<Polygon><outerBoundaryIs>"), ring(first), F.lit("</outerBoundaryIs>"), inner, F.lit("</Polygon>")))
    )
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title = F.coalesce(safe(F.try_element_at("attrs", F.lit(name))), F.lit(""))
    return features.select(F.concat(F.lit("<Placemark><name>"), title, F.lit("</name>"), shape, F.lit("</Placemark>")).alias("value"))


def write_kml(features: DataFrame, path: str, name: str = "name") -> None:
    """KML documents, one for each of the path's part files, each valid alone."""
    head, tail = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "</Document></kml>"

    def documents(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [head]})
        for batch in batches:
            yield batch[["value"]]
        yield pd.DataFrame({"value": [tail]})

    kml_placemarks(features, name).mapInPandas(documents, "value string").write.text(path)


def write_vector_dxf(features: DataFrame, path: str, layer: str = "layer") -> None:
    """POINT and POLYLINE entities; polygons are closed polylines, one for each ring, without the vertex that repeats the first."""
    name = F.coalesce(F.try_element_at("attrs", F.lit(layer)), F.lit("0"))
    xyz = lambda p: F.format_string("10\n%.6f\n20\n%.6f\n30\n%.6f", p["x"], p["y"], F.coalesce(p["z"], F.lit(0.0)))
    vertex = lambda p: F.concat(F.lit("0\nVERTEX\n8\n"), F.col("layer"), F.lit("\n"), xyz(p))
    rows = features.select("type", name.alias("layer"), F.explode("parts").alias("part"))
    n = F.size("part")
    again = (F.col("type") == "Polygon") & (n > 1) & F.col("part")[0].eqNullSafe(F.element_at("part", -1))
    rows = rows.withColumn("part", F.when(again, F.slice("part", F.lit(1), n - 1)).otherwise(F.col("part")))
    closed = F.when(F.col("type") == "Polygon", F.lit("1")).otherwise(F.lit("0"))
    line = F.concat(F.lit("0\nPOLYLINE\n8\n"), "layer", F.lit("\n66\n1\n70\n"), closed, F.lit("\n"), F.array_join(F.transform("part", vertex), "\n"), F.lit("\n0\nSEQEND"))
    text = F.when(F.col("type") == "Point", F.concat(F.lit("0\nPOINT\n8\n"), "layer", F.lit("\n"), xyz(F.col("part")[0]))).otherwise(line)

    def documents(batches):
        import pandas as pd

        yield pd.DataFrame({"value": ["0\nSECTION\n2\nENTITIES"]})
        for batch in batches:
            yield batch[["value"]]
        yield pd.DataFrame({"value": ["0\nENDSEC\n0\nEOF"]})

    rows.select(text.alias("value")).mapInPandas(documents, "value string").write.text(path)


def write_gcp_observations(rows: DataFrame, path: str) -> None:
    rows.select("image", "gcp", "px", "py").write.option("header", True).csv(path)


def write_cameras(cameras: DataFrame, path: str) -> None:
    """image, X, Y, Z and, from the rotation r11 to r33, omega, phi and kappa in degrees."""
    phi = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("r31"))))
    omega, kappa = F.atan2(F.col("r32"), -F.col("r33")), F.atan2(F.col("r21"), F.col("r11"))
    angles = [F.degrees(a).alias(n) for a, n in ((omega, "omega_deg"), (phi, "phi_deg"), (kappa, "kappa_deg"))]
    cameras.select("image", *[F.col(c).alias(c.upper()) for c in ("x", "y", "z")], *angles, F.col("f").alias("f_px")).coalesce(1).write.option("header", True).csv(path)


def default_columns(points: DataFrame) -> list[str]:
    """x, y and z, then what else is there of intensity, colour and class."""
    return ["x", "y", "z", *(c for c in ("intensity", "r", "g", "b", "classification") if c in points.columns)]


def column_choices(points: DataFrame) -> list[str]:
    """All columns of numbers that a text file can hold, coordinates first."""
    numbers = [c for c, t in points.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return [*(c for c in ("x", "y", "z") if c in numbers), *(c for c in numbers if c not in ("x", "y", "z"))]


def export(points: DataFrame, path: str, kind: str = "xyz", **settings) -> None:
    """Points as delimited text (`xyz`, `csv`) or LAS files (`las`)."""
    if kind == "las":
        from bathyal.sources import las

        return las.write_las(points, path, **settings)
    settings.setdefault("delimiter", "," if kind == "csv" else " ")
    return write_text(points, path, settings.pop("columns", default_columns(points)), **settings)


def geojson_features(features: DataFrame) -> DataFrame:
    """value: one Feature per line."""
    point = lambda p: F.when(p["z"].isNull(), F.array(p["x"], p["y"])).otherwise(F.array(p["x"], p["y"], p["z"]))
    line = F.transform("parts", lambda part: F.transform(part, point))
    text = F.when(F.col("type") == "Point", F.to_json(line[0][0])).when(F.col("type") == "LineString", F.to_json(line[0])).otherwise(F.to_json(line))
    geometry = F.concat(F.lit('{"type":"'), "type", F.lit('","coordinates":'), text, F.lit("}"))
    return features.select(F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json("attrs"), F.lit("}")).alias("value"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited features, which GeoJSON readers take file by file."""
    geojson_features(features).write.text(path)


def write_tables(sheets: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per sheet."""
    for name, frame in sheets.items():
        frame.write.option("header", True).csv(f"{path}/{name}")


def settings_sheet(spark: SparkSession, items: dict[str, object]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in items.items()], "setting string, value string")


def save_project(datasets: dict[str, DataFrame], path: str, meta: dict) -> None:
    """A Parquet table per dataset; the manifest is written last, so a project without one isn't complete."""
    if not datasets:
        raise ValueError("a project needs a dataset")
    for name, frame in datasets.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(datasets.values())).sparkSession
    manifest = {"version": 1, "datasets": sorted(datasets), **meta}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_project(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    return manifest, {n: spark.read.parquet(f"{path}/{n}") for n in manifest["datasets"]}
