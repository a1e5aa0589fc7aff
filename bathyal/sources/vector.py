"""Vector features from GeoJSON, KML, GPX, WKB and Shapefiles: rows of type, parts and attrs.

parts is a list of lists of points (x, y, z); attrs a map of texts. GeoJSON and GPX are read by DataFrame functions; binary
formats are decoded file by file in tasks, so many files are read at once.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator, Sequence
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bathyal.operators.graph import counted_off

PART = "array<struct<x:double,y:double,z:double>>"
SCHEMA = f"type string, parts array<{PART}>, attrs map<string,string>"


def _point(c: Column) -> Column:
    return F.struct(c[0].alias("x"), c[1].alias("y"), F.get(c, F.lit(2)).alias("z"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of collections, single features and bare geometries; multi-geometries are taken apart.

    A file is one document, or holds one on each line if its first line is a whole document.
    """
    text = spark.read.text(path, wholetext=True)
    first = F.json_object_keys(F.regexp_extract("value", r"\A\s*([^\r\n]*)", 1))  # null for part of a document
    text = text.select(F.explode(F.when(first.isNotNull(), F.split("value", "[\r\n]+")).otherwise(F.array("value"))).alias("value")).where("trim(value) <> ''")
    geometry = "struct<type:string,coordinates:string>"
    shape = f"struct<type:string,features:array<struct<geometry:{geometry},properties:map<string,string>>>,geometry:{geometry},properties:map<string,string>,coordinates:string>"
    doc = text.select(F.from_json("value", shape).alias("d"))
    one = F.array(F.struct(F.col("d.geometry").alias("geometry"), F.col("d.properties").alias("properties")))
    bare = F.array(F.struct(F.struct(F.col("d.type").alias("type"), F.col("d.coordinates").alias("coordinates")).alias("geometry"), F.lit(None).cast("map<string,string>").alias("properties")))
    items = F.when(F.col("d.features").isNotNull(), F.col("d.features")).when(F.col("d.type") == "Feature", one).otherwise(bare)
    rows = doc.select(F.explode(items).alias("f")).select("f.geometry.type", "f.geometry.coordinates", F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("attrs"))
    depth = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}

    def parsed(levels: int) -> Column:
        return F.from_json("coordinates", "array<" * levels + "array<double>" + ">" * levels)

    line = lambda c: F.transform(c, _point)
    as_parts = {
        0: lambda: F.array(F.array(F.array(_point(parsed(0))))),
        1: lambda: F.array(F.array(line(parsed(1)))),
        2: lambda: F.array(F.transform(parsed(2), line)),
        3: lambda: F.transform(parsed(3), lambda p: F.transform(p, line)),
    }
    out = None
    for kind, levels in depth.items():
        parts = as_parts[levels]()
        if kind == "MultiPoint":
            parts = F.transform(line(parsed(1)), lambda p: F.array(F.array(p)))
        if kind == "MultiLineString":
            parts = F.transform(F.transform(parsed(2), line), lambda p: F.array(p))
        name = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}.get(kind, kind)
        some = rows.where(F.col("type") == kind).select(F.lit(name).alias("type"), F.explode(parts).alias("parts"), "attrs")
        out = some if out is None else out.unionByName(some)
    return out


def decode_wkb(data: bytes, at: int = 0) -> tuple[list[tuple[str, list]], int]:
    """(type, parts) of each simple geometry, and where the reading stopped; ISO and EWKB forms of z are known."""
    order = "<" if data[at] else ">"
    code = struct.unpack_from(f"{order}I", data, at + 1)[0]
    at += 5
    has_z = bool(code & 0x80000000) or code % 100000 // 1000 in (1, 3)
    has_m = bool(code & 0x40000000) or code % 100000 // 1000 in (2, 3)
    if code & 0x20000000:
        at += 4
    kind, n_values = (code & 0xFFFF) % 1000, 2 + has_z + has_m

    def points(at: int, n: int) -> tuple[list, int]:
        flat = struct.unpack_from(f"{order}{n * n_values}d", data, at)
        return [(flat[i], flat[i + 1], flat[i + 2] if has_z else None) for i in range(0, len(flat), n_values)], at + 8 * n * n_values

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(f"{order}I", data, at)[0], at + 4

    if kind == 1:
        p, at = points(at, 1)
        return [("Point", [p])], at
    if kind == 2:
        n, at = count(at)
        p, at = points(at, n)
        return [("LineString", [p])], at
    if kind == 3:
        rings = []
        n, at = count(at)
        for _ in range(n):
            k, at = count(at)
            p, at = points(at, k)
            rings.append(p)
        return [("Polygon", rings)], at
    if kind in (4, 5, 6, 7):
        out = []
        n, at = count(at)
        for _ in range(n):
            more, at = decode_wkb(data, at)
            out += more
        return out, at
    raise ValueError(f"geometry type {kind} isn't known")


def from_wkb(rows: DataFrame, column: str) -> DataFrame:
    """rows without the WKB column, with type and parts; a row per simple geometry."""
    shape = f"array<struct<type:string,parts:array<{PART}>>>"

    @F.pandas_udf(shape)
    def decoded(column: pd.Series) -> pd.Series:
        return column.map(lambda b: [{"type": t, "parts": [[dict(zip("xyz", p)) for p in part] for part in parts]} for t, parts in decode_wkb(bytes(b))[0]] if b else [])

    return rows.withColumn("g", F.explode(decoded(column))).select(*[c for c in rows.columns if c != column], "g.type", "g.parts")


def _kml(content: bytes) -> Iterator[tuple]:
    space = "{http://www.opengis.net/kml/2.2}"

    def coordinates(node) -> list:
        text = (node.findtext(f".//{space}coordinates") or "").split()
        return [tuple(map(float, [*t.split(","), *["0"] * (3 - len(t.split(",")))])) for t in text]

    for mark in ElementTree.fromstring(content).iter(f"{space}Placemark"):
        attrs = {d.get("name"): d.findtext(f"{space}value") for d in mark.iter(f"{space}Data")}
        if name := mark.findtext(f"{space}name"):
            attrs["name"] = name
        for node in mark.iter():
            kind = node.tag.removeprefix(space)
            if kind in ("Point", "LineString"):
                yield kind, [coordinates(node)], attrs
            elif kind == "Polygon":
                rings = [*node.iter(f"{space}outerBoundaryIs"), *node.iter(f"{space}innerBoundaryIs")]
                yield kind, [coordinates(r) for r in rings], attrs


def _gpx(content: bytes) -> Iterator[tuple]:
    root = ElementTree.fromstring(content)
    space = root.tag[: root.tag.index("}") + 1] if "}" in root.tag else ""

    def point(n) -> tuple:
        height = n.findtext(f"{space}ele")
        return float(n.get("lon")), float(n.get("lat")), float(height) if height else None

    named = lambda n: {"name": t} if (t := n.findtext(f"{space}name")) else {}
    for n in root.iter(f"{space}wpt"):
        yield "Point", [[point(n)]], named(n)
    for n in root.iter(f"{space}rte"):
        yield "LineString", [[point(p) for p in n.iter(f"{space}rtept")]], named(n)
    for n in root.iter(f"{space}trk"):
        for s in n.iter(f"{space}trkseg"):
            yield "LineString", [[point(p) for p in s.iter(f"{space}trkpt")]], named(n)


def ring_area(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def dbf_rows(content: bytes) -> list[dict[str, str]]:
    """The records of a DBF file as texts; empty values are left out, records marked as deleted too."""
    n, head, width = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while at < head - 1 and content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), content[at + 16]))
        at += 32
    out = []
    for row in range(n):
        at = head + row * width
        if content[at : at + 1] == b"*":
            continue
        at, values = at + 1, {}
        for name, size in fields:
            raw, at = content[at : at + size], at + size
            try:
                text = raw.decode("utf-8").strip()
            except UnicodeDecodeError:
                text = raw.decode("latin-1").strip()
            if text.strip("\0"):
                values[name] = text
        out.append(values)
    return out


def _shp(content: bytes, rows: list[dict[str, str]] | None = None) -> Iterator[tuple]:
    """Points, lines and polygons; a clockwise ring begins a polygon, the others are its holes. rows: each record's attributes."""
    at, record = 100, -1
    while at + 8 <= len(content):
        record += 1
        attrs = rows[record] if rows and record < len(rows) else {}
        n = struct.unpack_from(">I", content, at + 4)[0] * 2
        body, at = content[at + 8 : at + 8 + n], at + 8 + n
        kind = struct.unpack_from("<I", body)[0]
        if kind in (1, 11, 21):
            x, y = struct.unpack_from("<2d", body, 4)
            yield "Point", [[(x, y, struct.unpack_from("<d", body, 20)[0] if kind == 11 else None)]], attrs
        elif kind in (3, 5, 13, 15, 23, 25):
            n_parts, n_points = struct.unpack_from("<2I", body, 36)
            firsts = [*struct.unpack_from(f"<{n_parts}I", body, 44), n_points]
            flat = struct.unpack_from(f"<{2 * n_points}d", body, 44 + 4 * n_parts)
            z_at = 44 + 4 * n_parts + 16 * n_points + 16
            z = struct.unpack_from(f"<{n_points}d", body, z_at) if kind in (13, 15) else [None] * n_points
            points = [(flat[2 * i], flat[2 * i + 1], z[i]) for i in range(n_points)]
            parts = [points[a:b] for a, b in zip(firsts, firsts[1:])]
            if kind % 10 == 3:
                for p in parts:
                    yield "LineString", [p], attrs
            else:
                held: list = []
                for p in parts:
                    if ring_area(p) <= 0 and held:
                        yield "Polygon", held, attrs
                        held = []
                    held.append(p)
                if held:
                    yield "Polygon", held, attrs


def _dxf(content: bytes) -> Iterator[tuple]:
    """LINE, POINT, LWPOLYLINE and POLYLINE entities of ASCII files, read line by line."""
    lines = io.TextIOWrapper(io.BytesIO(content), "utf-8", "replace")
    pairs = ((int(a), b.strip()) for a, b in zip(lines, lines) if a.strip().lstrip("-").isdigit())
    kind, layer, xs, ys, zs, closed = "", "", [], [], [], False

    def finish() -> Iterator[tuple]:
        points = [(x, y, z) for x, y, z in zip(xs, ys, [*zs, *[None] * (len(xs) - len(zs))])]
        if points and kind in ("POINT", "LINE", "LWPOLYLINE", "POLYLINE"):
            ring = [*points, points[0]] if closed else points
            yield "Point" if kind == "POINT" else "Polygon" if closed else "LineString", [ring], {"layer": layer}

    for code, value in pairs:
        if code == 0 and value not in ("VERTEX",):
            if not (value == "SEQEND" and kind == "POLYLINE"):
                yield from finish()
                kind, layer, xs, ys, zs, closed = value, "", [], [], [], False
        elif code == 8 and not layer:
            layer = value
        elif code in (10, 11) and (kind != "POLYLINE" or code == 10):
            xs.append(float(value))
        elif code in (20, 21):
            ys.append(float(value))
        elif code in (30, 31):
            zs.append(float(value))
        elif code == 70 and kind in ("LWPOLYLINE", "POLYLINE"):
            closed = bool(int(value) & 1)
        if kind == "POLYLINE" and code == 66:
            xs, ys, zs = [], [], []
    yield from finish()


#: So many features of a file are handed on at a time.
FEATURES = 1000

FORMATS = {"kml": _kml, "gpx": _gpx, "shp": _shp, "dxf": _dxf}


def read_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Features of all files under path, of a kind in FORMATS."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                features = FORMATS[kind](bytes(content))
                while some := list(islice(features, FEATURES)):
                    rows = [{"type": t, "parts": [[dict(zip("xyz", p)) for p in part] for part in parts], "attrs": attrs} for t, parts, attrs in some]
                    yield pd.DataFrame(rows, columns=["type", "parts", "attrs"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parsed, SCHEMA)


#: Names of attributes that hold a route's name, KP, depth of burial, seabed and level of the cable.
FIELD_KEYS = {
    "name": ("name", "route", "route_name", "cable", "id", "line", "label"),
    "kp": ("kp", "chainage", "km", "kmp"),
    "dob": ("dob", "burial", "depth of burial", "doc"),
    "seabed": ("seabed", "msbl", "seabed z", "seabed depth", "water depth", "wd"),
    "z": ("toc", "top of cable", "cable top", "cable z", "top z", "cable_z", "z", "elevation", "depth", "toc depth", "cable depth"),
}


def find_field(fields: Sequence[str], keys: Sequence[str]) -> str | None:
    """The field that has one of the names, sooner ones first, or else begins with one of more than two letters."""
    plain = {f.lower().replace("_", " "): f for f in fields}
    same = (plain[k] for k in keys if k in plain)
    begun = (f for k in keys if len(k) > 2 for name, f in plain.items() if name.startswith(k))
    return next(same, None) or next(begun, None)


def guess_fields(features: DataFrame) -> dict[str, str | bool | None]:
    """Which attributes to take for a route import: one of FIELD_KEYS each, z "geometry" where points have heights, and z_depth
    if the z field counts downwards by its name."""
    names = sorted(r[0] for r in attribute_fields(features).collect())  # names of fields, not of features
    heights = not features.where(F.exists(F.flatten("parts"), lambda p: F.abs(p["z"]) > 1e-9)).isEmpty()
    found = {k: find_field(names, keys) for k, keys in FIELD_KEYS.items()}
    depth = not heights and found["z"] is not None and "depth" in found["z"].lower()
    return found | {"z": "geometry" if heights else found["z"], "z_depth": depth}


def _told_apart(routes: DataFrame) -> DataFrame:
    """route_id: the label, with the line's number behind it where several lines share one."""
    alike = routes.groupBy("label").agg(F.count(F.lit(1)).alias("alike"))
    held = routes.join(alike, "label")
    return held.withColumn("route_id", F.when(F.col("alike") == 1, F.col("label")).otherwise(F.concat("label", F.lit(" #"), F.col("k").cast("string")))).drop("alike")


def routes_from_features(features: DataFrame, name: str = "name", base: str = "line") -> DataFrame:
    """route_id, seq, x, y, z of the line features' vertices: one route for each line, and for each part of a line of several.

    A route has the line's name; without one it is the base and the number of the line as read. Lines that share a name are told
    apart by their numbers.
    """
    lines = features.where("type = 'LineString'").select("attrs", F.explode("parts").alias("part"))
    lines = counted_off(lines)
    given = F.try_element_at("attrs", F.lit(name))
    label = F.when(F.length(given) > 0, given).otherwise(F.concat(F.lit(f"{base} "), F.col("k").cast("string")))
    routes = _told_apart(lines.select("k", label.alias("label"), "part"))
    return routes.select("route_id", F.posexplode("part").alias("seq", "p")).select("route_id", "seq", "p.*")


def routes_from_points(features: DataFrame, name: str | None = "name", kp: str | None = None, z: str | None = "geometry", z_depth: bool = False, dob: str | None = None, seabed: str | None = None, seabed_depth: bool = False, base: str = "route") -> DataFrame:
    """route_id, seq, x, y, z, kp, dob of point features: one route for each value of the name field, in order of KP where all
    of a route's points have one, else as read. Routes of one point are none.

    z: "geometry", a field, or None; without it the cable lies its depth of burial below the seabed field. Numbers may have a
    decimal comma; what isn't a number is null.
    """

    def number(field: str | None) -> Column:
        return F.regexp_replace(F.try_element_at("attrs", F.lit(field)), ",", ".").try_cast("double") if field else F.lit(None).cast("double")

    points = counted_off(features.where("type = 'Point'"))
    route = F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(base)) if name else F.lit(base)
    at = F.col("parts")[0][0]
    level = at["z"] if z == "geometry" else number(z)
    if z is None and dob and seabed:
        level = number(seabed) * (-1 if seabed_depth else 1) - number(dob)
    elif z_depth:
        level = -level
    rows = points.select(route.alias("route_id"), "k", at["x"].alias("x"), at["y"].alias("y"), level.alias("z"), number(kp).alias("kp"), number(dob).alias("dob"))
    whole = Window.partitionBy("route_id")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(whole), "ordered": F.count("kp").over(whole) == F.count(F.lit(1)).over(whole)}).where("n >= 2")
    order = Window.partitionBy("route_id").orderBy(F.when(F.col("ordered"), F.col("kp")), "k")
    return rows.select("route_id", (F.row_number().over(order) - 1).alias("seq"), "x", "y", "z", F.when(F.col("ordered"), F.col("kp")).alias("kp"), "dob")


def counts(features: DataFrame) -> DataFrame:
    return features.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def bounds(features: DataFrame) -> DataFrame:
    p = features.select(F.explode(F.flatten("parts")).alias("p"))
    return p.agg(F.min("p.x").alias("x1"), F.min("p.y").alias("y1"), F.max("p.x").alias("x2"), F.max("p.y").alias("y2"))


#: Attributes that name a feature, in order.
LABELS = ("name", "NAME", "Name", "id", "ID", "label", "layer")


def labelled(features: DataFrame) -> DataFrame:
    """features with label: the first attribute of LABELS that isn't empty, else the type."""
    named = [F.when(F.length(F.try_element_at("attrs", F.lit(k))) > 0, F.try_element_at("attrs", F.lit(k))) for k in LABELS]
    return features.withColumn("label", F.coalesce(*named, F.lower("type")))


def polygons(features: DataFrame) -> DataFrame:
    """label and ring: the outer rings of three vertices or more."""
    rings = labelled(features).where((F.col("type") == "Polygon") & (F.size(F.col("parts")[0]) >= 3))
    return rings.select("label", F.col("parts")[0].alias("ring"))


def lines(features: DataFrame) -> DataFrame:
    """label and line: the lines of two vertices or more."""
    found = labelled(features).where((F.col("type") == "LineString") & (F.size(F.col("parts")[0]) >= 2))
    return found.select("label", F.col("parts")[0].alias("line"))


def z_range(features: DataFrame) -> DataFrame:
    """The least and the greatest height that isn't 0; one row."""
    z = features.select(F.explode(F.flatten("parts")).alias("p")).select(F.col("p.z").alias("z")).where((F.abs("z") > 1e-9) & ~F.isnan("z"))
    return z.agg(F.min("z").alias("z1"), F.max("z").alias("z2"))


def attribute_fields(features: DataFrame) -> DataFrame:
    """name: all attributes that any feature has."""
    return features.select(F.explode(F.map_keys("attrs")).alias("name")).distinct()


def reproject(features: DataFrame, src: int, dst: int) -> DataFrame:
    """features from one coordinate system to another; heights stay."""
    from bathyal.functions.crs import transform

    if src == dst:
        return features

    def moved(p: Column) -> Column:
        x, y = transform(p["x"], p["y"], src, dst)
        return F.struct(x.alias("x"), y.alias("y"), p["z"].alias("z"))

    return features.withColumn("parts", F.transform("parts", lambda part: F.transform(part, moved)))


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """type, parts and attrs of a layer (the first one if none is named) of each GeoPackage under path; a file is one task's,
    held in memory."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for batch in batches:
            for content in batch["content"]:
                base = sqlite3.connect(":memory:")
                base.deserialize(bytes(content))
                names = [r[0] for r in base.execute("select table_name from gpkg_contents where data_type = 'features'")]
                name = layer if layer in names else names[0]
                column = base.execute("select column_name from gpkg_geometry_columns where table_name = ?", (name,)).fetchone()[0]
                rows = base.execute(f'select * from "{name}"')
                heads, found = [d[0] for d in rows.description], []
                for row in rows:
                    fields = dict(zip(heads, row))
                    blob = fields.pop(column)
                    if blob is None or blob[3] & 0x10:  # none, or an empty one
                        continue
                    skip = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]  # the envelope
                    attrs = {k: str(v) for k, v in fields.items() if v is not None and not isinstance(v, bytes)}
                    found += [{"type": t, "parts": [[dict(zip("xyz", p)) for p in part] for part in parts], "attrs": attrs} for t, parts in decode_wkb(bytes(blob), skip)[0]]
                base.close()
                yield pd.DataFrame(found, columns=["type", "parts", "attrs"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parsed, SCHEMA)


def read_shp(spark: SparkSession, path: str) -> DataFrame:
    """Features of all Shapefiles under path, with the attributes of the DBF file beside each."""
    base = lambda suffix: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path).select(F.regexp_replace("path", r"\.\w+$", "").alias("base"), F.col("content").alias(suffix))
    pairs = base("shp").join(base("dbf"), "base", "left").select("shp", "dbf")

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shp, dbf in zip(batch["shp"], batch["dbf"]):
                rows = dbf_rows(bytes(dbf)) if dbf is not None else None
                found = [{"type": t, "parts": [[dict(zip("xyz", p)) for p in part] for part in parts], "attrs": attrs} for t, parts, attrs in _shp(bytes(shp), rows)]
                yield pd.DataFrame(found, columns=["type", "parts", "attrs"])

    return pairs.mapInPandas(parsed, SCHEMA)


def layers(spark: SparkSession, path: str) -> DataFrame:
    """name: the feature layers of the GeoPackages under path."""

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for batch in batches:
            for content in batch["content"]:
                base = sqlite3.connect(":memory:")
                base.deserialize(bytes(content))
                yield pd.DataFrame({"name": [r[0] for r in base.execute("select table_name from gpkg_contents where data_type = 'features'")]})
                base.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(named, "name string")
