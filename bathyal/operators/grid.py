"""Gridding: representatives per cell, cell statistics, sparse surfaces and their values at points.

A surface is a sparse table of cells (row, col, z); a missing row is no data. Cell (row, col) has its centre at
((col + 0.5) * cell, (row + 0.5) * cell) from the origin. Everything but interpolation is one hash aggregate with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bathyal.functions.expressions import cell as cell_of
from bathyal.operators.graph import saved


def with_cells(points: DataFrame, cell: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    return points.withColumns({"col": cell_of("x", cell, origin[0]), "row": cell_of("y", cell, origin[1])})


def grid_extent(points: DataFrame, cell: float, snap: bool = True) -> DataFrame:
    """x0, ytop, rows and cols of the grid around all points, row 0 in the north; one row."""
    box = points.agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    down = lambda c: F.floor(F.col(c) / cell) * cell if snap else F.col(c)
    up = lambda c: F.ceil(F.col(c) / cell) * cell if snap else F.col(c)
    count = lambda a, b: F.greatest(F.lit(1), F.ceil((b - a) / cell - 1e-9)).cast("long")
    return box.select(down("x1").alias("x0"), up("y2").alias("ytop"), count(down("y1"), up("y2")).alias("rows"), count(down("x1"), up("x2")).alias("cols"))


def cell_pick(points: DataFrame, mode: str, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """One real point per cell: first, min (lowest id of equals), max (highest id) or the lower median."""
    row = F.struct(*[c for c in points.columns if c not in keys])
    order = F.struct("z", "point_id")
    if mode == "median":
        w = Window.partitionBy(*keys)
        ranked = points.withColumns({"rank": F.row_number().over(w.orderBy("z", "point_id")), "n": F.count(F.lit(1)).over(w)})
        return ranked.where(F.col("rank") == F.floor((F.col("n") - 1) / 2) + 1).drop("rank", "n")
    chosen = {"first": F.min_by(row, "point_id"), "min": F.min_by(row, order), "max": F.max_by(row, order)}[mode]
    return points.groupBy(*keys).agg(chosen.alias("p")).select(*keys, "p.*")


def thin_grid(points: DataFrame, cell: float, mode: str = "median") -> DataFrame:
    return cell_pick(with_cells(points, cell), mode)


def voxel_thin(points: DataFrame, cell: float) -> DataFrame:
    """The point nearest to each voxel's centroid."""
    keyed = points.withColumns({k: cell_of(c, cell) for k, c in (("vx", "x"), ("vy", "y"), ("vz", "z"))})
    keys = ["vx", "vy", "vz"]
    centre = keyed.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in ("x", "y", "z")])
    d2 = sum((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in ("x", "y", "z"))
    joined = keyed.join(centre, keys).withColumn("d2", F.round(d2, 12))
    return joined.groupBy(*keys).agg(F.min_by("point_id", F.struct("d2", "point_id")).alias("point_id"))


def build_dem(points: DataFrame, cell: float, method: str = "mean", shoal_high: bool = True, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """row, col, z; for shoal also the true place tx, ty of the chosen sounding."""
    keyed = with_cells(points, cell, origin)
    if method in ("mean", "min", "max", "count"):
        agg = {"mean": F.avg("z"), "min": F.min("z"), "max": F.max("z"), "count": F.count("z").cast("double")}[method]
        return keyed.groupBy("row", "col").agg(agg.alias("z"))
    if method == "median":
        return cell_pick(keyed, "median").select("row", "col", "z")
    if method == "shoal":
        return cell_pick(keyed, "max" if shoal_high else "min").select("row", "col", "z", F.col("x").alias("tx"), F.col("y").alias("ty"))
    raise ValueError(f"no such method: {method}")


def idw_dem(points: DataFrame, cell: float, radius: float | None = None, power: float = 2.0, k: int = 12) -> DataFrame:
    """Inverse-distance means of up to k points within `radius` (3 cells) of each centre of an occupied cell's surroundings."""
    radius = radius or 3 * cell
    reach = int(-(-radius // cell))
    span = F.sequence(F.lit(-reach), F.lit(reach))
    occupied = with_cells(points, cell).select("point_id", "x", "y", "z", "row", "col")
    near = occupied.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
    near = near.select("z", "point_id", "x", "y", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    d = F.sqrt(F.pow((F.col("col") + 0.5) * cell - F.col("x"), 2) + F.pow((F.col("row") + 0.5) * cell - F.col("y"), 2))
    near = near.withColumn("d", F.greatest(d, F.lit(1e-9))).where(F.col("d") <= radius)
    order = Window.partitionBy("row", "col").orderBy("d", "point_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("w", F.pow("d", F.lit(-power)))
    return best.groupBy("row", "col").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))


def median_surface(points: DataFrame, cell: float, min_points: int = 3) -> DataFrame:
    """The true median of each cell with at least min_points."""
    stats = with_cells(points, cell).groupBy("row", "col").agg(F.percentile("z", F.lit(0.5)).alias("z"), F.count("z").alias("n"))
    return stats.where(F.col("n") >= min_points).drop("n")


def _corners(points: DataFrame, cell: float) -> DataFrame:
    """The four cells whose centres surround each point, with bilinear weights."""
    gx, gy = F.col("x") / cell - 0.5, F.col("y") / cell - 0.5
    base = points.select("point_id", F.floor(gx).alias("c0"), F.floor(gy).alias("r0"), (gx - F.floor(gx)).alias("fx"), (gy - F.floor(gy)).alias("fy"))
    corner = lambda r, c, w: F.struct((F.col("r0") + r).alias("row"), (F.col("c0") + c).alias("col"), w.alias("w"))
    fx, fy = F.col("fx"), F.col("fy")
    four = F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(0, 1, fx * (1 - fy)), corner(1, 0, (1 - fx) * fy), corner(1, 1, fx * fy))
    return base.select("point_id", F.explode(four).alias("c")).select("point_id", "c.*")


def surface_at(points: DataFrame, surface: DataFrame, cell: float, need: int = 1, fallback: bool = False) -> DataFrame:
    """points with ref, the surface's bilinear value.

    Weights are renormalised over the corners that hold data; fewer than `need` corners give null. With fallback the nearest
    cell's value steps in.
    """
    corners = _corners(points, cell).where("w > 0 or true").join(surface.select("row", "col", F.col("z").alias("sz")), ["row", "col"])
    found = corners.groupBy("point_id").agg(
        F.sum(F.col("w") * F.col("sz")).alias("s"), F.sum("w").alias("t"), F.count(F.lit(1)).alias("n")
    )
    value = F.when((F.col("n") >= need) & (F.col("t") > 1e-12), F.col("s") / F.col("t"))
    out = points.join(found.select("point_id", value.alias("ref")), "point_id", "left")
    if fallback:
        own = with_cells(points, cell).select("point_id", "row", "col").join(surface.select("row", "col", F.col("z").alias("own")), ["row", "col"])
        out = out.join(own.select("point_id", "own"), "point_id", "left").withColumn("ref", F.coalesce("ref", "own")).drop("own")
    return out


def median_outliers(points: DataFrame, cell: float, mode: str = "abs", value: float = 0.3, side: str = "both", min_points: int = 3) -> DataFrame:
    """point_id and residual of points too far from the cells' median surface: by a fixed limit, or by `value` times the
    cell's scaled median absolute residual (the global one in cells of fewer than five; at least half the global one)."""
    rest = surface_at(points, median_surface(points, cell, min_points), cell).where("ref is not null")
    rest = with_cells(rest.withColumn("residual", F.col("z") - F.col("ref")), cell)
    limit: Column = F.lit(float(value))
    if mode == "mad":
        spread = lambda: 1.4826 * F.percentile(F.abs("residual"), F.lit(0.5))
        total = rest.agg(spread().alias("all_mad"))
        local = rest.groupBy("row", "col").agg(spread().alias("mad"), F.count(F.lit(1)).alias("n"))
        rest = rest.join(local, ["row", "col"]).crossJoin(F.broadcast(total))  # total is one row
        sigma = F.when(F.col("n") >= 5, F.col("mad")).otherwise(F.col("all_mad"))
        limit = value * F.greatest(sigma, 0.5 * F.col("all_mad"), F.lit(1e-3))
    far = {"both": F.abs("residual"), "shoal": F.col("residual"), "deep": -F.col("residual")}[side]
    return rest.where(far > limit).select("point_id", "residual")


def neighbours8(surface: DataFrame, reach: int = 1) -> DataFrame:
    """Each cell's data handed to all cells within `reach`: row, col (of the receiver), dr, dc and nz."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    out = surface.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
    return out.select((F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), "dr", "dc", F.col("z").alias("nz"))


def block(surface: DataFrame, factor: int, high: bool = True) -> DataFrame:
    """The shoalest value of each factor x factor block of cells."""
    rows = surface.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col"))
    return rows.agg((F.max if high else F.min)("z").alias("z"))


def window_max(surface: DataFrame, reach: int = 1) -> DataFrame:
    """The local maximum within `reach` cells, for cells that hold data. Rows and columns are taken one after the other."""

    def along(cells: DataFrame, axis: str, other: str) -> DataFrame:
        spread = cells.withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
        return spread.groupBy((F.col(axis) + F.col("d")).alias(axis), other).agg(F.max("z").alias("z"))

    most = along(along(surface.select("row", "col", "z"), "row", "col"), "col", "row")
    return surface.select("row", "col").join(most, ["row", "col"])


def xyz_grid_cell(points: DataFrame) -> DataFrame:
    """The spacing of points that lie on a grid: the smaller one of the axes' most frequent steps between sorted coordinates."""

    def modal(axis: str) -> DataFrame:
        # steps within ranges of coordinates, and those from one range to the next: a row for each range
        ranged = points.select(F.round(axis, 6).alias("v")).distinct().repartitionByRange("v").withColumn("part", F.spark_partition_id())
        ranged = saved(ranged)
        inner = ranged.select((F.col("v") - F.lag("v").over(Window.partitionBy("part").orderBy("v"))).alias("step"))
        ends = ranged.groupBy("part").agg(F.min("v").alias("first"), F.max("v").alias("last"))
        between = ends.select((F.col("first") - F.lag("last").over(Window.orderBy("first"))).alias("step"))
        return inner.union(between).select(F.round("step", 6).alias("step")).where("step > 0").groupBy("step").count()

    order = F.struct(F.col("count"), -F.col("step"))
    return modal("x").agg(F.max_by("step", order).alias("step")).union(modal("y").agg(F.max_by("step", order).alias("step"))).agg(F.min("step").alias("cell"))
