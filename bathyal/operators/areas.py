"""Polygons with holes around cells of one class: regions, their rings and depth areas.

Regions are 4-connected. They are labelled within tiles first, in numpy; only labels that meet across the borders of tiles go
through rounds of joins. Every side between a cell and one that isn't in its region is an edge with the region on its left, and
knows the edge after it from its cell's neighbours. Rings come from these links by doubling (`graph.chained`), so a long ring
is spread over tasks like everything else. Outer rings run counter-clockwise, holes clockwise.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bathyal.operators.graph import REACH, chained, components, saved
from bathyal.operators.hydrography import STANDARD_DEPTHS, safety_surface

TILE = 128


def _tile_regions(rows: pd.DataFrame) -> pd.DataFrame:
    """row, col, class and region of a tile's cells: the first cell of the region within the tile."""
    r, c = rows["row"].to_numpy(), rows["col"].to_numpy()
    r0, c0 = r.min(), c.min()
    wide = int(c.max() - c0 + 1)
    at = np.full((int(r.max() - r0 + 1), wide), -1)
    at[r - r0, c - c0] = np.arange(len(r))
    kind = rows["class"].to_numpy()
    pairs = [(at[:, :-1], at[:, 1:]), (at[:-1], at[1:])]
    a, b = (np.concatenate([p[k][(p[0] >= 0) & (p[1] >= 0)] for p in pairs]) for k in (0, 1))
    same = kind[a] == kind[b]
    a, b = a[same], b[same]
    first = np.lexsort((c, r))
    rank = np.empty(len(r), np.int64)
    rank[first] = np.arange(len(r))
    a, b, label = rank[a], rank[b], np.arange(len(r))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    own = first[label[rank]]
    region = ((r[own].astype(np.int64) + REACH) << 32) + c[own] + 2 * REACH
    return pd.DataFrame({"row": r, "col": c, "class": kind, "region": region})


def regions(cells: DataFrame, tile: int | None = None) -> DataFrame:
    """row, col, class, region: the 4-connected region of each cell, named after one of its cells. cells: row, col, class (a long);
    cells without a class are in no region."""
    tile = tile or TILE
    keyed = cells.where("class is not null").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("class").cast("long").alias("class"))
    tiles = keyed.groupBy(F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))
    local = saved(tiles.applyInPandas(_tile_regions, "row long, col long, class long, region long"))
    edges = None
    for axis, other in (("row", "col"), ("col", "row")):  # cells on both sides of a border between tiles
        high = local.where(F.pmod(F.col(axis) + 1, F.lit(tile)) == 0).select((F.col(axis) + 1).alias(axis), other, "class", F.col("region").alias("a"))
        low = local.where(F.pmod(F.col(axis), F.lit(tile)) == 0).select(axis, other, "class", F.col("region").alias("b"))
        met = high.join(low.hint("merge"), [axis, other, "class"]).select("a", "b")
        edges = met if edges is None else edges.unionByName(met)
    edges = saved(edges.distinct())
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    whole = components(nodes, edges).select(F.col("id").alias("region"), "component")
    return local.join(whole.hint("merge"), "region", "left").select("row", "col", "class", F.coalesce("component", "region").alias("region"))


#: Sides of a cell (0 south, 1 east, 2 north, 3 west), counter-clockwise: where they begin and end (columns, rows), the cell beyond,
#: and the cells ahead on the left and on the right (rows, columns).
SIDES = [
    ((0, 0), (1, 0), (-1, 0), (0, 1), (-1, 1)),
    ((1, 0), (1, 1), (0, 1), (1, 0), (1, 1)),
    ((1, 1), (0, 1), (1, 0), (0, -1), (1, -1)),
    ((0, 1), (0, 0), (0, -1), (-1, 0), (-1, -1)),
]


def _side_id(row: Column, col: Column, side: int) -> Column:
    return F.shiftleft(row + REACH, 33) + F.shiftleft(col + REACH, 2) + side


def ring_edges(cells: DataFrame) -> DataFrame:
    """region, id, nxt, turns, x1, y1, x2, y2 (in cells): every side of a region, the one after it, and whether that turns.

    Where two cells of one region touch at a corner only, the ring turns from the corner back along its own cell.
    """
    offsets = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    name = lambda dr, dc: f"n{dr + 1}{dc + 1}"
    each = cells.select("row", "col", "region", F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets])).alias("d"))
    seen = each.groupBy((F.col("row") - F.col("d.dr")).alias("row"), (F.col("col") - F.col("d.dc")).alias("col")).agg(
        *[F.max(F.when((F.col("d.dr") == dr) & (F.col("d.dc") == dc), F.col("region"))).alias(name(dr, dc)) for dr, dc in offsets]
    )
    seen = seen.where(F.col(name(0, 0)).isNotNull()).withColumnRenamed(name(0, 0), "region")
    row, col = F.col("row"), F.col("col")
    within = lambda d: F.col(name(*d)).eqNullSafe(F.col("region"))
    sides = []
    for k, (start, end, beyond, left, right) in enumerate(SIDES):
        turned = _side_id(row, col, (k + 1) % 4)
        straight = _side_id(row + left[0], col + left[1], k)
        back = _side_id(row + right[0], col + right[1], (k + 3) % 4)
        nxt = F.when(~within(left), turned).when(~within(right), straight).otherwise(back)
        turns = ~within(left) | within(right)
        place = [(col + p[0]).alias(f"x{i}") for i, p in ((1, start), (2, end))] + [(row + p[1]).alias(f"y{i}") for i, p in ((1, start), (2, end))]
        sides.append(F.when(~within(beyond), F.struct(_side_id(row, col, k).alias("id"), nxt.alias("nxt"), turns.alias("turns"), *place)))
    out = seen.select("region", F.explode(F.filter(F.array(*sides), lambda s: s.isNotNull())).alias("s"))
    return out.select("region", "s.*")


def rings(cells: DataFrame, cell: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Rings (region, ring, outer, area, length) and their corners (region, ring, outer, seq, x, y) of all regions (row, col, region).

    seq rises along the ring, with gaps where it goes straight on; the last corner isn't followed by the first again. The area of
    a hole is negative, so a region's areas add up to that of its cells.
    """
    edges = saved(ring_edges(cells))
    placed = saved(edges.join(chained(edges.select("id", "nxt")).hint("merge"), "id"))
    area = (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    facts = placed.groupBy("region", F.col("chain").alias("ring")).agg((F.sum(area) * cell * cell).alias("area"), (F.count(F.lit(1)) * cell).alias("length"))
    facts = saved(facts.select("region", "ring", (F.col("area") > 0).alias("outer"), "area", "length"))
    corner = placed.where("turns").select("region", F.col("chain").alias("ring"), (-F.col("left")).alias("seq"), (F.col("x2") * cell).alias("x"), (F.col("y2") * cell).alias("y"))
    inner = facts.where("not outer").select("ring", F.lit(False).alias("outer"))
    return facts, corner.join(inner.hint("merge"), "ring", "left").select("region", "ring", F.coalesce("outer", F.lit(True)).alias("outer"), "seq", "x", "y")


def polygons(corners: DataFrame) -> DataFrame:
    """region and parts: one row for each region with its rings as arrays of x and y, outer ring first, each closed."""
    ring = corners.groupBy("region", "ring", "outer").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    closed = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    ring = ring.select("region", F.struct((~F.col("outer")).alias("inner"), "ring", closed.alias("p")).alias("r"))
    return ring.groupBy("region").agg(F.sort_array(F.collect_list("r")).alias("r")).select("region", F.transform("r", lambda r: r["p"]).alias("parts"))


def outline(mask: DataFrame, cell: float = 1.0, tile: int | None = None) -> DataFrame:
    """seq, x, y: corners of the outer ring that holds the largest area among all regions of the cells (row, col)."""
    facts, corners = rings(regions(mask.select("row", "col", F.lit(1).alias("class")), tile), cell)
    most = facts.where("outer").agg(F.max_by("ring", F.struct("area", "ring")).alias("ring"))
    return corners.join(F.broadcast(most), "ring").select("seq", "x", "y")  # most is one row


def depth_areas(surface: DataFrame, cell: float, levels: Sequence[float] = STANDARD_DEPTHS, bias_cells: int = 1, tile: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Areas between consecutive depth levels of the shoal-biased surface: facts (region, drval1, drval2, cells, area, length, holes)
    and corners (region, ring, outer, seq, x, y).

    Levels outside the depths there are play no part; the first area begins at the least depth, the last ends at the greatest.
    """
    biased = saved(safety_surface(surface, bias_cells).where("z is not null and not isnan(z)").select("row", "col", (-F.col("z")).alias("depth")))
    ends = biased.agg(F.min("depth").alias("low"), F.max("depth").alias("high")).first()
    inside = [float(d) for d in levels if ends.low is not None and ends.low < d < ends.high]
    edges = [ends.low, *inside, ends.high] if ends.low is not None else []
    kind = F.lit(0)
    for k, d in enumerate(inside):
        kind = F.when(F.col("depth") >= d, k + 1).otherwise(kind)
    named = saved(regions(biased.select("row", "col", kind.alias("class")), tile))
    facts, corners = rings(named, cell)
    of_ring = facts.groupBy("region").agg(F.sum("area").alias("area"), F.sum("length").alias("length"), F.count_if(~F.col("outer")).alias("holes"))
    size = named.groupBy("region").agg(F.first("class").alias("class"), F.count(F.lit(1)).alias("cells"))
    bounds = lambda k: F.get(F.array(*[F.lit(round(e, 2)) for e in edges]) if edges else F.array().cast("array<double>"), k)
    out = size.join(of_ring, "region").select("region", bounds(F.col("class").cast("int")).alias("drval1"), bounds((F.col("class") + 1).cast("int")).alias("drval2"), "cells", "area", "length", "holes")
    return out, corners
