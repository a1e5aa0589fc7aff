"""Grids in text: ESRI ASCII rasters and rows of x, y, z that lie on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bathyal.operators.grid import xyz_grid_cell
from bathyal.sources.text import numbered_lines

HEADER = ("ncols", "nrows", "xllcorner", "xllcenter", "yllcorner", "yllcenter", "cellsize", "nodata_value")


def is_esri_ascii(first_line: str) -> bool:
    return first_line.strip().lower().startswith("ncols")


def ascii_header(spark: SparkSession, path: str) -> dict[str, float]:
    """The header's numbers; x0 and y0 are the lower left corner."""
    head = [r.value.split() for r in spark.read.text(path).limit(8).collect()]
    found = {t[0].lower(): float(t[1]) for t in head if len(t) == 2 and t[0].lower() in HEADER}
    cell = found["cellsize"]
    for axis in ("x", "y"):
        corner = found.get(f"{axis}llcorner", found.get(f"{axis}llcenter", 0.0) - cell / 2)
        found[f"{axis}0"] = corner
    return found


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """row (from the north), col, x, y (cell centres) and z of cells that hold data."""
    h = ascii_header(spark, path)
    cell, n_rows = h["cellsize"], int(h["nrows"])
    data = numbered_lines(spark, path).where(~F.lower(F.trim("value")).rlike("^[a-z]") & (F.trim("value") != ""))
    first = data.agg(F.min("line").alias("first"))
    rows = data.crossJoin(F.broadcast(first)).select((F.col("line") - F.col("first")).alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "v"))
    z = F.col("v").try_cast("double")
    cells = rows.select("row", F.col("col").cast("long").alias("col"), z.alias("z")).where(F.col("z") != h.get("nodata_value", -9999.0))
    x, y = h["x0"] + (F.col("col") + 0.5) * cell, h["y0"] + (n_rows - F.col("row") - 0.5) * cell
    return cells.select("row", "col", x.alias("x"), y.alias("y"), "z")


def read_xyz_grid(points: DataFrame) -> DataFrame:
    """row (from the north), col, z and cell of points on a regular grid; of several points in a cell the last one counts."""
    size = xyz_grid_cell(points)
    box = points.agg(F.min("x").alias("x1"), F.max("y").alias("y2"))
    placed = points.crossJoin(F.broadcast(size.crossJoin(box)))  # one row
    row = F.round((F.col("y2") - F.col("y")) / F.col("cell")).cast("long")
    col = F.round((F.col("x") - F.col("x1")) / F.col("cell")).cast("long")
    return placed.groupBy(row.alias("row"), col.alias("col")).agg(F.max_by("z", "point_id").alias("z"), F.first("cell").alias("cell"))


def sample(points: DataFrame, cells: DataFrame, x0: float, y0: float, cell: float) -> DataFrame:
    """points with the bilinear value of cells (row from the south, col, z) around them; see surface_at."""
    from bathyal.operators.grid import surface_at

    moved = points.withColumns({"__x": F.col("x"), "__y": F.col("y"), "x": F.col("x") - x0, "y": F.col("y") - y0})
    out = surface_at(moved, cells.where((F.abs("z") < 1e6) & ~F.isnan("z")), cell)
    return out.withColumns({"x": F.col("__x"), "y": F.col("__y")}).drop("__x", "__y")
