"""Ground filters: lowest cells, morphological openings and height classes.

Openings are native: erosion and dilation by a square of cells are a minimum and a maximum over neighbouring rows, then
columns, of a sparse cell table, so a grid of any size is one plan of hash aggregates. Missing cells take part in neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bathyal.functions.expressions import cell as cell_of
from bathyal.operators.cloth import csf
from bathyal.operators.graph import saved
from bathyal.operators.grid import neighbours8, surface_at


def _spread(cells: DataFrame, axis: str, other: str, reach: int, low: bool) -> DataFrame:
    out = cells.withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    return out.groupBy((F.col(axis) + F.col("d")).alias(axis), other).agg((F.min if low else F.max)("z").alias("z"))


def opening(surface: DataFrame, reach: int) -> DataFrame:
    """Erosion, then dilation, by a square of 2 * reach + 1 cells; only cells that hold data keep a value."""
    own = surface.select("row", "col")

    def pass_over(cells: DataFrame, low: bool) -> DataFrame:
        spread = _spread(_spread(cells, "row", "col", reach, low), "col", "row", reach, low)
        return spread.join(own, ["row", "col"], "left_semi").select("row", "col", "z")

    return pass_over(pass_over(surface.select("row", "col", "z"), True), False)


def lowest(points: DataFrame, cell: float) -> DataFrame:
    return points.groupBy(cell_of("y", cell).alias("row"), cell_of("x", cell).alias("col")).agg(F.min("z").alias("z"))


def slope_surface(surface: DataFrame, cell: float) -> DataFrame:
    """row, col, z: the size of the gradient, by central differences, or one-sided ones where a neighbour is missing."""
    own = surface.select("row", "col", "z")
    side = lambda dr, dc, name: own.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("z").alias(name))
    for dr, dc, name in ((0, 1, "e"), (0, -1, "w"), (1, 0, "n"), (-1, 0, "s")):
        own = own.join(side(dr, dc, name), ["row", "col"], "left")
    along = lambda a, b: F.coalesce((F.col(a) - F.col(b)) / 2, F.col(a) - F.col("z"), F.col("z") - F.col(b), F.lit(0.0)) / cell
    gx, gy = along("e", "w"), along("n", "s")
    return own.select("row", "col", F.sqrt(gx * gx + gy * gy).alias("z"))


def _on_surface(points: DataFrame, surface: DataFrame, cell: float) -> DataFrame:
    """point_id, z, ref and slope: the surface and the size of its gradient, bilinear at each point."""
    at = surface_at(points, surface, cell, fallback=True)
    steep = surface_at(points.select("point_id", "x", "y", "z"), slope_surface(surface, cell), cell, fallback=True)
    return at.select("point_id", "z", "ref").join(steep.select("point_id", F.col("ref").alias("slope")), "point_id")


def smrf(points: DataFrame, cell: float = 1.0, slope: float = 0.15, window: float = 18.0, threshold: float = 0.5, scalar: float = 1.25) -> DataFrame:
    """point_id, ground, height: openings of growing size; a cell that drops by over slope * reach * cell is an object. Ground
    lies within threshold + scalar * slope of the surface without objects."""
    base = saved(lowest(points, cell))
    last, objects = base, None
    for reach in range(1, int(-(-window // cell)) + 1):
        opened = saved(opening(base, reach))
        gone = last.join(opened.withColumnRenamed("z", "o"), ["row", "col"]).where(F.col("z") - F.col("o") > slope * reach * cell).select("row", "col")
        objects = gone if objects is None else objects.union(gone)
        last = opened
    bare = saved(base.join(objects.distinct(), ["row", "col"], "left_anti"))
    height = F.col("z") - F.col("ref")
    limit = threshold + scalar * F.coalesce("slope", F.lit(0.0))
    return _on_surface(points, bare, cell).select("point_id", F.coalesce(F.abs(height) <= limit, F.lit(False)).alias("ground"), height.alias("height"))


def pmf_windows(cell: float, max_window: float, slope: float, initial_dh: float, max_dh: float) -> list[tuple[int, float]]:
    """Sizes 2 * 2**k + 1, in cells, of windows of up to max_window metres, and each one's height limit, which follows from the
    growth of the window before it."""
    out: list[tuple[int, float]] = []
    limit, before = initial_dh, 1
    while (size := 2 * 2 ** len(out) + 1) * cell <= max_window:
        out.append((size, limit))
        limit, before = min(slope * (size - before) * cell + initial_dh, max_dh), size
    return out


def pmf(points: DataFrame, cell: float = 1.0, max_window: float = 33.0, slope: float = 0.15, initial_dh: float = 0.15, max_dh: float = 2.5) -> DataFrame:
    """point_id, ground: points over the surface opened by growing windows by more than a window's height limit aren't ground."""
    surface = saved(lowest(points, cell))
    left = points.select("point_id", "z", cell_of("y", cell).alias("row"), cell_of("x", cell).alias("col"))
    for size, dh in pmf_windows(cell, max_window, slope, initial_dh, max_dh):
        surface = saved(opening(surface, size // 2))
        left = left.join(surface.withColumnRenamed("z", "o"), ["row", "col"]).where(F.col("z") - F.col("o") <= dh).select("point_id", "z", "row", "col")
    return points.select("point_id").join(left.select("point_id", F.lit(True).alias("g")), "point_id", "left").select("point_id", F.coalesce("g", F.lit(False)).alias("ground"))


def grid_minimum(points: DataFrame, cell: float = 5.0, threshold: float = 0.5) -> DataFrame:
    """point_id, ground: no higher over the bilinear 3 x 3 mean of the cells' minima than the threshold and slope * cell."""
    least = lowest(points, cell)
    mean = neighbours8(least).groupBy("row", "col").agg(F.avg("nz").alias("z"))
    mean = saved(mean.join(least.select("row", "col"), ["row", "col"], "left_semi"))
    ground = F.col("z") - F.col("ref") <= threshold + F.coalesce("slope", F.lit(0.0)) * cell
    return _on_surface(points, mean, cell).select("point_id", F.coalesce(ground, F.lit(False)).alias("ground"))


FILTERS = {"smrf": smrf, "pmf": pmf, "csf": csf, "gridmin": grid_minimum}


def ground(points: DataFrame, method: str, **settings: float) -> DataFrame:
    """point_id and ground by one of the FILTERS."""
    return FILTERS[method](points, **settings).select("point_id", "ground")


def height_above_ground(points: DataFrame, ground_points: DataFrame, cell: float = 1.0) -> DataFrame:
    """point_id and height over the mean surface of the ground points; none where no cell of it is near."""
    surface = ground_points.groupBy(cell_of("y", cell).alias("row"), cell_of("x", cell).alias("col")).agg(F.avg("z").alias("z"))
    return surface_at(points, surface, cell, fallback=True).select("point_id", (F.col("z") - F.col("ref")).alias("height"))


def classify(points: DataFrame, method: str, height_cell: float = 1.0, bands: tuple[float, float, float] = (0.5, 2.0, 5.0), **settings: float) -> DataFrame:
    """point_id, ground, height, class: a ground filter, then classes of all other points by their height over the
    mean of ground points in cells of height_cell. settings: the filter's own."""
    found = saved(points.join(ground(points, method, **settings), "point_id"))
    height = height_above_ground(found.where("not ground"), found.where("ground"), height_cell)
    rows = found.select("point_id", "ground").join(height, "point_id", "left")
    return height_classes(rows, bands)


def height_classes(with_height: DataFrame, bands: tuple[float, float, float] = (0.5, 2.0, 5.0)) -> DataFrame:
    """Adds class by height above ground: 2 ground, 1 low, 3, 4 and 5 low, medium and high vegetation."""
    h = F.col("height")
    kind = F.when(F.col("ground"), 2).when(h.isNull() | (h < bands[0]), 1).when(h < bands[1], 3).when(h < bands[2], 4).otherwise(5)
    return with_height.withColumn("class", kind)


def marking_candidates(points: DataFrame, cell: float = 2.0, k: float = 3.0, min_pct: float = 80.0) -> DataFrame:
    """Points brighter than the cell's upper median by k scaled median deviations, and than the global percentile."""
    from pyspark.sql import Window

    keyed = points.withColumns({"row": cell_of("y", cell), "col": cell_of("x", cell)})
    w = Window.partitionBy("row", "col")

    def upper_median(rows: DataFrame, value: str, name: str) -> DataFrame:
        ranked = rows.withColumns({"r": F.row_number().over(w.orderBy(value, "point_id")) - 1, "n": F.count(F.lit(1)).over(w)})
        return ranked.withColumn(name, F.max(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col(value))).over(w)).drop("r", "n")

    rows = upper_median(keyed, "intensity", "mid").withColumn("dev", F.abs(F.col("intensity") - F.col("mid")))
    rows = upper_median(rows, "dev", "mad")
    least = points.agg(F.percentile("intensity", F.lit(min_pct / 100)).alias("least"))
    bright = rows.crossJoin(F.broadcast(least))  # one row
    return bright.where((F.col("intensity") > F.col("mid") + k * 1.4826 * F.col("mad")) & (F.col("intensity") >= F.col("least"))).select("point_id", "intensity")
