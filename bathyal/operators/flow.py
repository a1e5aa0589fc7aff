"""Water and holes on sparse surfaces: filled sinks, flow directions, accumulation, inundation, holidays and hole filling.

Each is a repeated join of cells. Accumulation doubles its steps in every round; the others go on by one cell, so their number
of rounds is that of cells along the longest path, and large surfaces are made coarser first (grid.block). States are written
between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bathyal.operators.graph import cell_id, components, saved
from bathyal.operators.grid import neighbours8

#: Fixed value: how much a filled sink rises per cell towards its inside, in metres.
RISE = 1e-5


def _ring(surface: DataFrame) -> DataFrame:
    """row, col, nz of the eight neighbours' data, with the distance in cells."""
    return neighbours8(surface).where("dr <> 0 or dc <> 0").withColumn("run", F.sqrt(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")))


def fill_sinks(surface: DataFrame) -> DataFrame:
    """row, col, z, filled: the lowest surface above z from which every cell drains to a border of the data.

    Border cells keep their height; others start without a bound and take the least bound that a neighbour allows, until
    nothing changes.
    """
    ring = _ring(surface).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    start = F.when(F.coalesce("n", F.lit(0)) < 8, F.col("z")).otherwise(F.lit(float("inf")))
    now = saved(surface.select("row", "col", "z").join(ring, ["row", "col"], "left").select("row", "col", "z", start.alias("filled")))
    while True:
        low = _ring(now.select("row", "col", F.col("filled").alias("z"))).groupBy("row", "col").agg(F.min("nz").alias("low"))
        new = F.least("filled", F.greatest("z", F.coalesce(F.col("low") + RISE, F.lit(float("inf")))))
        step = saved(now.join(low, ["row", "col"], "left").select("row", "col", "z", F.col("filled").alias("old"), new.alias("filled")))
        now = step.drop("old")
        if step.where("old <> filled").isEmpty():
            return now


def directions(filled: DataFrame, value: str = "filled") -> DataFrame:
    """row, col, to_row, to_col: the neighbour down the steepest slope; none for cells without a lower one. Ties go to the first in order."""
    own = filled.select("row", "col", F.col(value).alias("z"))
    ring = _ring(own).join(own.withColumnRenamed("z", "own"), ["row", "col"]).withColumn("drop", (F.col("own") - F.col("nz")) / F.col("run")).where("drop > 0")
    best = ring.groupBy("row", "col").agg(F.max_by(F.struct("dr", "dc"), F.struct("drop", -F.col("dr"), -F.col("dc"))).alias("d"))
    return own.join(best, ["row", "col"], "left").select("row", "col", (F.col("row") + F.col("d.dr")).alias("to_row"), (F.col("col") + F.col("d.dc")).alias("to_col"))


def accumulation(flow: DataFrame) -> DataFrame:
    """row, col, cells: how many cells drain through each, itself included. flow: row, col, to_row, to_col.

    In every round a cell hands what it holds to the cell that it reaches in twice as many steps as before, so the number of
    rounds is the logarithm of the longest path.
    """
    start = flow.select("row", "col", cell_id(F.col("row"), F.col("col")).alias("id"), cell_id(F.col("to_row"), F.col("to_col")).alias("jump"), F.lit(1).cast("long").alias("cells"))
    now = saved(start)
    while not (live := now.where("jump IS NOT NULL")).isEmpty():
        arrived = live.groupBy(F.col("jump").alias("id")).agg(F.sum("cells").alias("more"))
        onward = now.select(F.col("id").alias("jump"), F.col("jump").alias("further"))
        further = live.join(onward, "jump", "left").select("row", "col", "id", F.col("further").alias("jump"), "cells")
        all_cells = further.unionByName(now.where("jump IS NULL"))
        now = saved(all_cells.join(arrived, "id", "left").select("row", "col", "id", "jump", (F.col("cells") + F.coalesce("more", F.lit(0))).alias("cells")))
    return now.select("row", "col", "cells")


def streams(accumulated: DataFrame, least_cells: int) -> DataFrame:
    return accumulated.where(F.col("cells") >= least_cells)


def cell_components(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """row, col, component of cells that touch (8 or 4 neighbours)."""
    key = lambda r, c: F.shiftleft(F.col(r) + (1 << 30), 31) + F.col(c) + (1 << 30)
    nodes = cells.select("row", "col", key("row", "col").alias("id"))
    near = neighbours8(nodes.withColumnRenamed("id", "z")).where("dr <> 0 or dc <> 0" if diagonal else "abs(dr) + abs(dc) = 1")
    edges = near.join(nodes, ["row", "col"]).select(F.col("id").alias("a"), F.col("nz").alias("b"))
    return nodes.join(components(nodes.select("id"), edges), "id").select("row", "col", "component")


def inundation(surface: DataFrame, level: float, seed: tuple[int, int]) -> DataFrame:
    """Cells under the level that are connected to the seed cell (row, col), with their depth of water."""
    low = saved(surface.where(F.col("z") < level).select("row", "col", "z"))
    part = cell_components(low)
    chosen = part.where((F.col("row") == seed[0]) & (F.col("col") == seed[1])).select("component")
    return low.join(part.join(chosen, "component", "left_semi"), ["row", "col"]).select("row", "col", (level - F.col("z")).alias("water"))


def holes(cells: DataFrame) -> DataFrame:
    """row, col, component, n: missing cells that no way of 4-connected missing cells leads from to the border of the data's box."""
    box = cells.agg(F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("col").alias("c1"), F.max("col").alias("c2"))
    rows = cells.groupBy("row").agg(F.min("col").alias("a"), F.max("col").alias("b"))  # outside a row's data nothing is a hole by rows
    inside = rows.withColumn("col", F.explode(F.sequence("a", "b"))).select("row", "col")
    gaps = saved(inside.join(cells.select("row", "col"), ["row", "col"], "left_anti"))
    part = saved(cell_components(gaps, diagonal=False))
    # a gap that touches a place outside its row's data, or the box, is open
    edge = part.join(rows, "row").crossJoin(F.broadcast(box))  # box is one row
    span = F.array(*[F.struct((F.col("row") + d).alias("row"), F.col("col").alias("col")) for d in (-1, 1)])
    beside = part.select("component", F.explode(span).alias("p")).select("component", "p.row", "p.col").join(rows, "row", "left")
    out = beside.where("a is null or col < a or col > b").select("component")
    touching = edge.where("row = r1 or row = r2 or col = c1 or col = c2").select("component")
    closed = part.join(out.union(touching).distinct(), "component", "left_anti")
    return closed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("component")))


def fill_holes(surface: DataFrame, max_cells: int) -> DataFrame:
    """surface with holes of up to max_cells filled from the nearest cell that holds data, ring by ring."""
    left = saved(holes(surface).where(F.col("n") <= max_cells).select("row", "col"))
    now = saved(surface.select("row", "col", "z"))
    while not left.isEmpty():
        near = _ring(now).join(left, ["row", "col"], "left_semi")
        new = near.groupBy("row", "col").agg(F.min_by("nz", F.struct("run", "dr", "dc")).alias("z"))
        new = saved(new)
        now, left = saved(now.union(new)), saved(left.join(new, ["row", "col"], "left_anti"))
    return now
