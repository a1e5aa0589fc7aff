"""Sections along a line and comparison of surfaces over a region."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bathyal.functions.expressions import in_polygon, segment_offsets
from bathyal.operators.flow import holes
from bathyal.operators.graph import saved
from bathyal.operators.grid import surface_at


def section_places(spark: SparkSession, line: Sequence[tuple[float, float]], step: float) -> DataFrame:
    """point_id, ch, x, y: places on a line at even distances of about `step`, both ends among them."""
    pieces, cum = [], 0.0
    for (x1, y1), (x2, y2) in zip(line, line[1:]):
        length = math.hypot(x2 - x1, y2 - y1)
        if length > 0:
            pieces.append((cum, cum + length, x1, y1, (x2 - x1) / length, (y2 - y1) / length))
            cum += length
    n = max(2, math.ceil(cum / step) + 1)
    ch = F.col("point_id") * (cum / (n - 1))
    x, y = F.lit(None).cast("double"), F.lit(None).cast("double")
    for a, _, x1, y1, ux, uy in pieces:  # the last piece that has begun holds the place
        x, y = F.when(ch >= a, x1 + (ch - a) * ux).otherwise(x), F.when(ch >= a, y1 + (ch - a) * uy).otherwise(y)
    return spark.range(n).toDF("point_id").select("point_id", ch.alias("ch"), x.alias("x"), y.alias("y"))


def dem_section(surface: DataFrame, cell: float, line: Sequence[tuple[float, float]], step: float | None = None) -> DataFrame:
    """ch and z, bilinear; null where any of the four cells around holds no data."""
    places = section_places(surface.sparkSession, line, step or cell / 2).withColumn("z", F.lit(None).cast("double"))
    return surface_at(places, surface, cell, need=4).select("ch", F.col("ref").alias("z"))


def region_cells(spark: SparkSession, cell: float, inside: Column, box: tuple[float, float, float, float]) -> DataFrame:
    """row and col of all cells in a box (x1, y1, x2, y2) whose centre lies inside."""
    r1, r2 = math.floor(box[1] / cell), math.floor(box[3] / cell)
    c1, c2 = math.floor(box[0] / cell), math.floor(box[2] / cell)
    rows = spark.range(r1, r2 + 1).toDF("row").withColumn("col", F.explode(F.sequence(F.lit(c1).cast("long"), F.lit(c2).cast("long"))))
    return rows.withColumns({"x": (F.col("col") + 0.5) * cell, "y": (F.col("row") + 0.5) * cell}).where(inside).select("row", "col")


def polygon_cells(spark: SparkSession, cell: float, ring: Sequence[tuple[float, float]]) -> DataFrame:
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return region_cells(spark, cell, in_polygon(F.col("x"), F.col("y"), ring), (min(xs), min(ys), max(xs), max(ys)))


def corridor_cells(spark: SparkSession, cell: float, line: Sequence[tuple[float, float]], half_width: float) -> DataFrame:
    xs, ys = [p[0] for p in line], [p[1] for p in line]
    near = segment_offsets(F.col("x"), F.col("y"), line)["dist"] <= half_width
    return region_cells(spark, cell, near, (min(xs) - half_width, min(ys) - half_width, max(xs) + half_width, max(ys) + half_width))


def compare(a: DataFrame, b: DataFrame | float, cell: float, region: DataFrame | None = None) -> DataFrame:
    """Statistics of a - b where both hold data; b may be a constant. One row.

    region: row and col of the cells to look at. Without one the region is the cells with data in both and the holes between
    them, so that coverage tells how much of the surveyed area both hold.
    """
    other = a.select("row", "col", F.lit(float(b)).alias("zb")) if isinstance(b, (int, float)) else b.select("row", "col", F.col("z").alias("zb"))
    both = a.select("row", "col", "z").join(other, ["row", "col"]).select("row", "col", (F.col("z") - F.col("zb")).alias("d"))
    if region is None:
        both = saved(both)
        region = both.select("row", "col").union(holes(both.select("row", "col")).select("row", "col"))
    else:
        both = both.join(region, ["row", "col"], "left_semi")
    area = cell * cell
    d = F.col("d")
    part = lambda mask, v: F.coalesce(F.sum(F.when(mask, v)), F.lit(0.0)) * area
    stats = both.agg(
        F.count(F.lit(1)).alias("cells"),
        part(d > 0, d).alias("fill_volume"), part(d > 0, F.lit(1.0)).alias("fill_area"),
        part(d < 0, -d).alias("cut_volume"), part(d < 0, F.lit(1.0)).alias("cut_area"),
        part(F.lit(True), d).alias("net_volume"),
        F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"),
        F.percentile(d, F.lit(0.05)).alias("p05"), F.percentile(d, F.lit(0.95)).alias("p95"),
    )
    total = region.agg(F.count(F.lit(1)).alias("n"))
    out = stats.crossJoin(F.broadcast(total))  # each is one row
    more = {"area": F.col("cells") * area, "region_area": F.col("n") * area, "coverage": F.col("cells") / F.greatest("n", F.lit(1))}
    return out.withColumns(more).drop("n")
