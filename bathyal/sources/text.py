"""Delimited survey text: what a file looks like is guessed from its first lines; rows are read by Spark."""

from __future__ import annotations

import codecs
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Regular expressions by delimiter name, in order of preference.
DELIMITERS = {"comma": ",", "tab": "\t", "semicolon": ";", "pipe": r"\|", "space": r"\s+"}
#: Metres per unit.
UNITS = {"m": 1.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048}
ROLES = ("X", "Y", "Z", "Intensity", "R", "G", "B", "Classification", "Custom", "Skip")
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def detect_encoding(head: bytes) -> str:
    """UTF-8, else Big5, else Latin-1; a character that the head cuts off is no error."""
    for name in ("utf-8-sig", "cp950"):
        decoder = codecs.getincrementaldecoder(name)()
        try:
            decoder.decode(head, final=False)
            return name
        except UnicodeDecodeError as e:
            if e.start >= len(head) - 4:
                return name
    return "latin-1"


def read_head(spark: SparkSession, path: str, nbytes: int = 65536) -> bytes:
    """The first bytes of a file, by Spark's file reader."""
    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, nbytes)).first()
    return bytes(row[0]) if row else b""


def read_preview(spark: SparkSession, path: str, n_lines: int = 200) -> list[str]:
    return [r.value for r in spark.read.text(path).limit(n_lines).collect()]


def split_tokens(line: str, delimiter: str) -> list[str]:
    import re

    return [t.strip() for t in re.split(DELIMITERS[delimiter], line.strip())]


def _number(token: str) -> bool:
    try:
        float(token)
        return True
    except ValueError:
        return False


def _numeric(line: str, delimiter: str, least: int = 3) -> bool:
    tokens = split_tokens(line, delimiter)
    return len(tokens) >= least and all(map(_number, tokens))


def detect_delimiter(lines: Sequence[str], least: int = 3) -> str:
    """The delimiter that makes the most of the last 30 lines all numbers."""
    tail = [x for x in lines if x.strip()][-30:]
    scores = {d: sum(_numeric(x, d, least) for x in tail) for d in DELIMITERS}
    best = max(scores, key=lambda d: scores[d])
    return best if scores[best] else "space"


def detect_start_row(lines: Sequence[str], delimiter: str) -> int:
    """The first of three numeric rows of one width."""
    width = [len(split_tokens(x, delimiter)) if _numeric(x, delimiter) else 0 for x in lines]
    for i, w in enumerate(width):
        near = width[i : i + 3]
        if w and all(v == w for v in near):
            return i
    return 0


def guess_roles(rows: Sequence[Sequence[float]]) -> list[str]:
    n = min(len(r) for r in rows)
    rest = n - 3
    colour = lambda cols: all(float(r[c]).is_integer() and 0 <= r[c] <= 65535 for r in rows for c in cols)
    if rest == 1:
        return ["X", "Y", "Z", "Intensity"]
    if rest == 3 and colour(range(3, 6)):
        return ["X", "Y", "Z", "R", "G", "B"]
    if rest == 4 and colour(range(4, 7)):
        return ["X", "Y", "Z", "Intensity", "R", "G", "B"]
    return ["X", "Y", "Z", *["Custom"] * max(rest, 0)]


def validate_roles(roles: Sequence[str]) -> str:
    """Why the roles can't be used, or an empty text."""
    for r in ("X", "Y", "Z"):
        if roles.count(r) != 1:
            return f"{r} must be given exactly once"
    twice = [r for r in ROLES[3:8] if roles.count(r) > 1]
    return f"{twice[0]} is given more than once" if twice else ""


def _split(delimiter: str) -> Column:
    return F.split(F.trim("value"), DELIMITERS[delimiter])


def number(token: Column, decimal_comma: bool = False) -> Column:
    """A number, or null where the text isn't one."""
    plain = F.regexp_replace(token, ",", ".") if decimal_comma else token
    return F.trim(plain).try_cast("double")


def numbered_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """value, line (its number in its file, from 0) and id (a number of its own, rising with the place). Lines of each split are counted first, so that a split knows how
    many lines stand before it; a file has one row per split."""
    reader = spark.read.option("encoding", encoding) if encoding and encoding != "utf-8-sig" else spark.read
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(F.broadcast(starts), ["file", "block"]).select("value", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "id")


def read_xyz(spark: SparkSession, path: str, skip_rows: int, delimiter: str, roles: Sequence[str], z_is_depth: bool = False, encoding: str | None = None) -> DataFrame:
    """point_id, x, y, z and the other roles' columns; rows without x, y or z are dropped. skip_rows: of each file."""
    if problem := validate_roles(list(roles)):
        raise ValueError(problem)
    lines = numbered_lines(spark, path, encoding).where((F.col("line") >= skip_rows) & (F.trim("value") != ""))
    tokens = lines.withColumn("t", _split(delimiter))
    names = {"X": "x", "Y": "y", "Z": "z", "Intensity": "intensity", "R": "r", "G": "g", "B": "b", "Classification": "classification"}
    columns = [number(F.get("t", F.lit(i))).alias(names.get(r, f"col_{i + 1}")) for i, r in enumerate(roles) if r != "Skip"]
    rows = tokens.select(F.col("id").alias("point_id"), *columns).dropna(subset=["x", "y", "z"])
    return rows.withColumn("z", -F.col("z")) if z_is_depth else rows


def parse_angle(text: Column) -> Column:
    """Degrees from a decimal number or degrees, minutes and seconds with a hemisphere; south and west are negative."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1)
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    size = part(0) + part(1) / 60 + part(2) / 3600
    negative = text.rlike(r"(?i)[SW]\s*$|^\s*[SW]|^\s*-")
    return F.when(F.size(parts) > 0, F.when(negative, -size).otherwise(size))


def cable_level(value: Column, unit: str = "m", is_depth: bool = False, offset: float = 0.0, diameter: float = 0.0, reference: str = "top") -> Column:
    """The cable's top from a value that is its top, centre or bottom, as a height or a depth, in some unit."""
    z = value * UNITS[unit]
    z = (-z if is_depth else z) + offset
    return z + {"top": 0.0, "centre": diameter / 2, "bottom": diameter}[reference]


def read_route_table(spark: SparkSession, path: str, delimiter: str, columns: dict[str, int], skip_rows: int = 0, decimal_comma: bool = False, comment: str = "#", angles: bool = False, kp_unit: str = "km", level: dict | None = None) -> DataFrame:
    """route_id, seq, x, y, kp (km) and z; columns: the places of route, x, y, kp and z, those that there are."""
    lines = numbered_lines(spark, path).where((F.col("line") >= skip_rows) & (F.trim("value") != "") & ~F.ltrim("value").startswith(comment))
    tokens = lines.withColumn("t", _split(delimiter))
    token = lambda name: F.get("t", F.lit(columns[name]))
    value = lambda name: number(token(name), decimal_comma) if name in columns else F.lit(None).cast("double")
    x, y = (parse_angle(token("x")), parse_angle(token("y"))) if angles else (value("x"), value("y"))
    route = F.trim(token("route")) if "route" in columns else F.lit("route")
    z = cable_level(value("z"), **(level or {}))
    kp = value("kp") / (1000 if kp_unit == "m" else 1)
    rows = tokens.select(route.alias("route_id"), F.col("line").alias("seq"), x.alias("x"), y.alias("y"), kp.alias("kp"), z.alias("z"))
    return rows.dropna(subset=["x", "y", *(["kp"] if "kp" in columns else [])])


def read_structures(spark: SparkSession, path: str, delimiter: str, columns: dict[str, int], skip_rows: int = 0, default_diameter: float = 8.0) -> DataFrame:
    """name, x, y, diameter; a missing diameter or one of 0 is the default, unnamed structures get numbers."""
    tokens = numbered_lines(spark, path).where(F.col("line") >= skip_rows).withColumn("t", _split(delimiter))
    value = lambda name: number(F.get("t", F.lit(columns[name]))) if name in columns else F.lit(None).cast("double")
    name = F.trim(F.get("t", F.lit(columns["name"]))) if "name" in columns else F.lit("")
    auto = F.concat(F.lit("S"), F.lpad((F.col("line") - skip_rows + 1).cast("string"), 2, "0"))
    diameter = F.when(value("diameter") > 0, value("diameter")).otherwise(F.lit(default_diameter))
    rows = tokens.select(F.when(F.length(name) > 0, name).otherwise(auto).alias("name"), value("x").alias("x"), value("y").alias("y"), diameter.alias("diameter"))
    return rows.dropna(subset=["x", "y"])


def read_value_table(spark: SparkSession, path: str, delimiter: str, x: int = 0, y: int = 1, values: Sequence[int] = (2,)) -> DataFrame:
    """x, y, v1, v2, ...; rows in which any isn't a finite number (the header too) are dropped."""
    tokens = spark.read.text(path).withColumn("t", _split(delimiter))
    names = ["x", "y", *(f"v{i + 1}" for i in range(len(values)))]
    rows = tokens.select(*[number(F.get("t", F.lit(c))).alias(n) for c, n in zip((x, y, *values), names)]).dropna()
    finite = [~F.isnan(n) & (F.abs(n) != float("inf")) for n in names]
    for f in finite:
        rows = rows.where(f)
    return rows


#: Header words by column; a whole header that equals one counts before one of its words does.
CAMERA_NAMES = {
    "x": ("x", "easting", "east"),
    "y": ("y", "northing", "north"),
    "z": ("z", "altitude", "alt", "elevation", "height"),
    "omega": ("omega", "omega_deg"),
    "phi": ("phi", "phi_deg"),
    "kappa": ("kappa", "kappa_deg"),
    "f": ("f_px", "focal_px"),
    "w": ("width",),
    "h": ("height_px", "image_height"),
    "cx": ("cx",),
    "cy": ("cy",),
}


def camera_columns(header: Sequence[str]) -> dict[str, int]:
    """Where each known column stands; a header of numbers means image, x, y, z."""
    import re

    heads = [h.strip().lower() for h in header]
    if len(heads) > 3 and all(map(_number, heads[1:4])):
        return {"x": 1, "y": 2, "z": 3}
    words = [[t for t in re.split(r"[^a-z0-9]+", h) if t] for h in heads]
    out: dict[str, int] = {}
    for column, names in CAMERA_NAMES.items():
        for n in names:
            whole = [i for i, h in enumerate(heads) if h == n]
            part = [i for i, t in enumerate(words) if (n in t or "_".join(t) == n) and not (n == "height" and len(t) > 1)]
            if whole or part:
                out[column] = (whole or part)[0]
                break
    if not {"x", "y", "z"} <= set(out):
        raise ValueError("a camera file needs columns for x, y and z")
    return out


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """image, x, y, z, omega, phi, kappa, f, w, h, cx, cy and, where the angles (degrees) are given, r11 to r33: the rotation
    from the world to the camera (x to the right, y down, z ahead)."""
    lines = [v for v in read_preview(spark, path) if v.strip() and not v.startswith("#")]
    if not lines:
        raise ValueError(f"{path} holds no cameras")
    text = "\n".join(lines)
    delimiter = max(("comma", "semicolon", "tab"), key=lambda d: text.count(DELIMITERS[d])) if any(DELIMITERS[d] in text for d in ("comma", "semicolon", "tab")) else "space"
    places = camera_columns(split_tokens(lines[0].lstrip("\ufeff"), delimiter))
    tokens = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("t", _split(delimiter))
    value = lambda name: number(F.get("t", F.lit(places[name]))) if name in places else F.lit(None).cast("double")
    rows = tokens.select(F.trim(F.get("t", F.lit(0))).alias("image"), *[value(k).alias(k) for k in CAMERA_NAMES]).dropna(subset=["x", "y", "z"])
    (so, co), (sp, cp), (sk, ck) = ((F.sin(F.radians(a)), F.cos(F.radians(a))) for a in ("omega", "phi", "kappa"))
    matrix = {
        "r11": cp * ck, "r12": co * sk + so * sp * ck, "r13": so * sk - co * sp * ck,
        "r21": cp * sk, "r22": so * sp * sk - co * ck, "r23": -(so * ck + co * sp * sk),
        "r31": -sp, "r32": so * cp, "r33": -(co * cp),
    }
    return rows.withColumns(matrix)


def cameras_from_features(features: DataFrame, name: str = "name") -> DataFrame:
    """image, x, y, z of the point features that have a height."""
    p = F.col("parts")[0][0]
    points = features.where(F.col("type") == "Point").select(F.coalesce(F.col("attrs")[name], F.lit("")).alias("image"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))
    return points.dropna(subset=["x", "y", "z"])


def read_gcp_coordinates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, x double, y double, z double").option("header", True).csv(path)


def read_gcp_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("image string, gcp string, px double, py double").option("header", True).csv(path)


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    return files.where(F.lower("path").rlike(r"\.(jpe?g|png|tiff?)$"))
