"""Surfaces: comparison, volumes, terrain products, design rules and stockpiles on sparse cell tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bathyal.functions.expressions import in_polygon
from bathyal.operators.grid import neighbours8


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """row, col, za, zb and dz = za - zb of cells that both hold."""
    both = a.select("row", "col", F.col("z").alias("za")).join(b.select("row", "col", F.col("z").alias("zb")), ["row", "col"])
    return both.withColumn("dz", F.col("za") - F.col("zb"))


def in_region(cells: DataFrame, cell: tuple[float, float], ring: Sequence[tuple[float, float]]) -> DataFrame:
    """Cells whose centre lies in the polygon."""
    return cells.where(in_polygon((F.col("col") + 0.5) * cell[0], (F.col("row") + 0.5) * cell[1], ring))


def volumes(diff: DataFrame, area: float) -> DataFrame:
    """Fill, cut and net volume and areas, and statistics of dz, in one row; area: of a cell."""
    dz = F.col("dz")
    return diff.agg(
        F.count(F.lit(1)).alias("cells"),
        (F.sum(F.when(dz > 0, dz).otherwise(0.0)) * area).alias("fill"),
        (F.sum(F.when(dz < 0, -dz).otherwise(0.0)) * area).alias("cut"),
        (F.sum(dz) * area).alias("net"),
        (F.sum((dz > 0).cast("long")) * area).alias("fill_area"),
        (F.sum((dz < 0).cast("long")) * area).alias("cut_area"),
        F.avg(dz).alias("mean"),
        F.stddev_pop(dz).alias("std"),
        F.min(dz).alias("least"),
        F.max(dz).alias("most"),
        F.percentile(dz, F.lit(0.05)).alias("p05"),
        F.percentile(dz, F.lit(0.95)).alias("p95"),
    )


def dod(before: DataFrame, after: DataFrame, area: float, sigma_a: float = 0.05, sigma_b: float = 0.05, t: float = 1.96, years: float | None = None, keys: Sequence[Column] = ()) -> DataFrame:
    """Erosion and deposition over the level of detection t * sqrt(sigma_a**2 + sigma_b**2)."""
    lod = t * (sigma_a**2 + sigma_b**2) ** 0.5
    dz = F.col("dz")
    rows = difference(after, before).withColumn("real", F.abs(dz) > lod).groupBy(*keys)
    out = rows.agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum(F.col("real").cast("long")).alias("changed"),
        (F.sum(F.when(F.col("real") & (dz < 0), -dz).otherwise(0.0)) * area).alias("erosion"),
        (F.sum(F.when(F.col("real") & (dz > 0), dz).otherwise(0.0)) * area).alias("deposition"),
    ).withColumn("net", F.col("deposition") - F.col("erosion"))
    return out.withColumn("net_per_year", F.col("net") / years) if years else out


def gradient(surface: DataFrame, cell: tuple[float, float]) -> DataFrame:
    """row, col, z, gx, gy: central differences, one-sided where only one neighbour holds data."""
    n = neighbours8(surface).where("abs(dr) + abs(dc) = 1")
    side = lambda dr, dc: F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("nz")))
    sides = n.groupBy("row", "col").agg(side(0, -1).alias("w"), side(0, 1).alias("e"), side(-1, 0).alias("s"), side(1, 0).alias("n"))
    rows = surface.select("row", "col", "z").join(sides, ["row", "col"], "left")
    step = lambda a, b, d: F.coalesce((F.col(b) - F.col(a)) / (2 * d), (F.col(b) - F.col("z")) / d, (F.col("z") - F.col(a)) / d)
    return rows.select("row", "col", "z", step("w", "e", cell[0]).alias("gx"), step("s", "n", cell[1]).alias("gy"))


def slope(surface: DataFrame, cell: tuple[float, float]) -> DataFrame:
    """row, col, slope in degrees."""
    g = gradient(surface, cell)
    return g.select("row", "col", F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))).alias("slope")).where("slope is not null")


def slope_stats(surface: DataFrame, cell: tuple[float, float], thresholds: Sequence[float] = (5.0, 10.0, 15.0)) -> DataFrame:
    s = slope(surface, cell)
    over = [(F.avg((F.col("slope") > t).cast("double")) * 100).alias(f"over_{t:g}") for t in thresholds]
    return s.agg(F.count(F.lit(1)).alias("cells"), F.avg("slope").alias("mean"), F.max("slope").alias("most"), F.percentile("slope", F.lit(0.95)).alias("p95"), *over)


def aspect_sectors(surface: DataFrame, cell: tuple[float, float], flat: float = 0.5) -> DataFrame:
    """Cells per 45-degree sector of the downhill direction, clockwise from north; cells flatter than `flat` have none."""
    g = gradient(surface, cell).where("gx is not null and gy is not null")
    steep = F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))
    towards = F.degrees(F.atan2(-F.col("gx"), -F.col("gy")))
    sector = F.floor(F.pmod(towards + 22.5, F.lit(360.0)) / 45).cast("int")
    return g.where(steep >= flat).groupBy(sector.alias("sector")).agg(F.count(F.lit(1)).alias("cells"))


def roughness(surface: DataFrame) -> DataFrame:
    """row, col, tri: the mean absolute difference to the neighbours that hold data."""
    n = neighbours8(surface).where("dr <> 0 or dc <> 0").join(surface.select("row", "col", "z"), ["row", "col"])
    return n.groupBy("row", "col").agg(F.avg(F.abs(F.col("nz") - F.col("z"))).alias("tri"))


def curvature(surface: DataFrame, cell: float) -> DataFrame:
    """row, col, curvature: minus the Laplacian times 100, where all four neighbours hold data."""
    n = neighbours8(surface).where("abs(dr) + abs(dc) = 1").groupBy("row", "col").agg(F.sum("nz").alias("s"), F.count(F.lit(1)).alias("k"))
    rows = surface.join(n.where("k = 4"), ["row", "col"])
    return rows.select("row", "col", (-(F.col("s") - 4 * F.col("z")) / (cell * cell) * 100).alias("curvature"))


def deviation(with_ref: DataFrame, above: float = 0.5, below: float = 0.5) -> DataFrame:
    """point_id and dz = z - ref of points over or under a surface by more than the limits."""
    rows = with_ref.withColumn("dz", F.col("z") - F.col("ref"))
    return rows.where((F.col("dz") > above) | (F.col("dz") < -below)).select("point_id", "dz")


def deviation_stats(with_ref: DataFrame, within: float = 0.1) -> DataFrame:
    d = F.col("z") - F.col("ref")
    return with_ref.where(d.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.percentile(F.abs(d), F.lit(0.95)).alias("p95"), F.avg((F.abs(d) <= within).cast("double")).alias("share")
    )


def surface_models(points: DataFrame, cell: float, vegetation: tuple[int, ...] = (3, 4, 5), building: int = 6, ground: int = 2, canopy_min: float = 2.0) -> DataFrame:
    """Per cell: dsm, dtm (lowest ground point), ndsm, canopy height and whether a building stands there."""
    keyed = points.groupBy(F.floor(F.col("y") / cell).alias("row"), F.floor(F.col("x") / cell).alias("col"))
    of = lambda mask: F.when(mask, F.col("z"))
    cells = keyed.agg(
        F.max("z").alias("dsm"),
        F.min(of(F.col("classification") == ground)).alias("dtm"),
        F.max(of(F.col("classification").isin(*vegetation))).alias("top"),
        F.max((F.col("classification") == building).cast("int")).alias("building"),
    )
    height = F.col("top") - F.col("dtm")
    return cells.select("row", "col", "dsm", "dtm", (F.col("dsm") - F.col("dtm")).alias("ndsm"), F.when(height >= canopy_min, height).alias("chm"), "building")


def level_design(surface: DataFrame, cell: tuple[float, float], ring: Sequence[tuple[float, float]], level: float, overdredge: float = 0.0) -> DataFrame:
    """Cut and fill to a level within a polygon, without side slopes: one row."""
    inside = in_region(surface, cell, ring).withColumn("dz", F.lit(level - overdredge) - F.col("z"))
    area = cell[0] * cell[1]
    dz = F.col("dz")
    return inside.agg(
        F.count(F.lit(1)).alias("cells"),
        (F.sum(F.when(dz < -1e-9, -dz).otherwise(0.0)) * area).alias("cut"),
        (F.sum(F.when(dz > 1e-9, dz).otherwise(0.0)) * area).alias("fill"),
    )


def stockpiles(surveys: DataFrame, cell: tuple[float, float], polygons: Sequence[tuple[str, Sequence[tuple[float, float]]]], level: float, density: float | None = None) -> DataFrame:
    """Per polygon and survey: volume above and below a level, height, tonnage and the change since the survey before.

    surveys: survey (sortable), row, col, z.
    """
    names = F.array(*[F.struct(F.lit(n).alias("name"), in_polygon((F.col("col") + 0.5) * cell[0], (F.col("row") + 0.5) * cell[1], ring).alias("hit")) for n, ring in polygons])
    rows = surveys.withColumn("p", F.explode(names)).where("p.hit").withColumn("h", F.col("z") - level)
    area = cell[0] * cell[1]
    out = rows.groupBy(F.col("p.name").alias("name"), "survey").agg(
        (F.sum(F.greatest(F.col("h"), F.lit(0.0))) * area).alias("above"), (F.sum(F.greatest(-F.col("h"), F.lit(0.0))) * area).alias("below"), F.max("h").alias("height")
    )
    w = Window.partitionBy("name").orderBy("survey")
    out = out.withColumn("change", F.col("above") - F.lag("above").over(w))
    return out.withColumn("tonnes", F.col("above") * density) if density else out


def rings(points_or_cells: DataFrame, structures: DataFrame, r_max: float, x: Column, y: Column) -> DataFrame:
    """Cells (z) within r_max diameters of each structure, with their distance r and bearing.

    Cells are bucketed by the largest reach, so only touching buckets meet.
    """
    reach = structures.agg(F.max("diameter")).first()[0]
    size = float(reach or 1.0) * r_max
    span = F.sequence(F.lit(-1), F.lit(1))
    s = structures.withColumn("bx", F.explode(F.transform(span, lambda d: F.floor(F.col("x") / size) + d)))
    s = s.withColumn("by", F.explode(F.transform(span, lambda d: F.floor(F.col("y") / size) + d)))
    s = s.select("structure_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "diameter", "bx", "by")
    c = points_or_cells.withColumns({"px": x, "py": y})
    c = c.withColumns({"bx": F.floor(F.col("px") / size), "by": F.floor(F.col("py") / size)})
    r = F.sqrt(F.pow(F.col("px") - F.col("sx"), 2) + F.pow(F.col("py") - F.col("sy"), 2))
    bearing = F.pmod(F.degrees(F.atan2(F.col("px") - F.col("sx"), F.col("py") - F.col("sy"))), F.lit(360.0))
    return c.join(s, ["bx", "by"]).withColumns({"r": r, "bearing": bearing}).where(F.col("r") <= r_max * F.col("diameter")).drop("bx", "by")


def scour(ringed: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("structure_id",), least_cells: int = 10) -> DataFrame:
    """Per structure: reference (median of the outer half), greatest depth below it with distance and bearing, and the mean depth."""
    outer = F.col("r") > 0.6 * F.max(F.col("r")).over(Window.partitionBy(*keys))
    ref = ringed.withColumn("outer", outer).groupBy(*keys).agg(F.percentile(F.when(F.col("outer"), F.col("z")), F.lit(0.5)).alias("reference"), F.sum(F.col("outer").cast("int")).alias("n_outer"))
    rows = ringed.join(ref.where(F.col("n_outer") >= least_cells), list(keys)).withColumn("depth", F.col("reference") - F.col("z"))
    return rows.groupBy(*keys).agg(
        F.first("reference").alias("reference"),
        F.max("depth").alias("depth"),
        F.max_by("r", F.struct("depth", -F.col("r"))).alias("at_r"),
        F.max_by("bearing", F.struct("depth", -F.col("r"))).alias("at_bearing"),
        F.sum((F.col("depth") > threshold).cast("int")).alias("cells_over"),
    )
