"""Block models of buildings in a classified cloud: footprints, heights and closed prisms, and triangles of polygons with holes.

Footprints are the outlines of regions of cells that hold building points. Ground and roof heights are aggregates by region. The
corners of one footprint, after simplification a few dozen, are one small group, in which the polygon is cut into triangles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bathyal.functions.expressions import cell as cell_of
from bathyal.operators.areas import regions, rings
from bathyal.operators.contours import kept_by_tolerance
from bathyal.operators.graph import saved
from bathyal.operators.grid import neighbours8

Place = tuple[float, float]


def _twice_area(ring: Sequence[Place]) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, [*ring[1:], ring[0]], strict=True))


def _turn(a: Place, b: Place, c: Place) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _bridged(outer: list[int], holes: list[list[int]], at: Sequence[Place]) -> list[int]:
    """One ring around an outer ring (counter-clockwise) and its holes (clockwise): each hole is entered and left by a bridge from
    its rightmost corner to a corner that it sees."""
    for hole in sorted(holes, key=lambda h: -max(at[i][0] for i in h)):
        k = max(range(len(hole)), key=lambda i: (at[hole[i]][0], at[hole[i]][1]))
        start = at[hole[k]]
        hole = hole[k:] + hole[:k]

        sides = [(at[p], at[q]) for loop in (outer, *holes) for p, q in zip(loop, [*loop[1:], loop[0]], strict=True)]

        def clear(j: int, start: Place = start, sides: list = sides) -> bool:
            to = at[outer[j]]
            for a, b in sides:
                if to in (a, b) or start in (a, b):
                    continue
                if _turn(start, to, a) * _turn(start, to, b) <= 0 and _turn(a, b, start) * _turn(a, b, to) <= 0:
                    return False
            before, here, after = at[outer[j - 1]], to, at[outer[(j + 1) % len(outer)]]
            inside = _turn(before, here, start) >= 0, _turn(here, after, start) >= 0
            return all(inside) if _turn(before, here, after) > 0 else any(inside)

        order = sorted(range(len(outer)), key=lambda j: (at[outer[j]][0] - start[0]) ** 2 + (at[outer[j]][1] - start[1]) ** 2)
        j = next((j for j in order if clear(j)), order[0])
        outer = outer[: j + 1] + hole + [hole[0]] + outer[j:]
    return outer


def triangulated(parts: Sequence[Sequence[Place]]) -> tuple[list[Place], list[tuple[int, int, int]]]:
    """Corners and triangles (counter-clockwise) of a polygon: its outer ring and holes, in either direction, not closed.

    Ears, corners whose triangle holds no other corner, are cut from the bridged ring one after another.
    """
    at: list[Place] = []
    loops = []
    for k, part in enumerate(parts):
        ring = [(float(x), float(y)) for x, y in part]
        if (_twice_area(ring) > 0) != (k == 0):
            ring.reverse()
        loops.append(list(range(len(at), len(at) + len(ring))))
        at += ring
    ring = _bridged(loops[0], loops[1:], at)
    out = []
    last = 0
    while len(ring) > 3:
        best = None
        for step in range(len(ring)):
            k = (last + step) % len(ring)
            a, b, c = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
            if _turn(at[a], at[b], at[c]) <= 0:
                continue
            own = (at[a], at[b], at[c])
            if not any(at[p] not in own and _turn(at[a], at[b], at[p]) > 0 and _turn(at[b], at[c], at[p]) > 0 and _turn(at[c], at[a], at[p]) >= 0 for p in ring):
                best = k
                break
        if best is None:  # a corner on a straight line, else the flattest one
            ring.pop(min(range(len(ring)), key=lambda k: abs(_turn(at[ring[k - 1]], at[ring[k]], at[ring[(k + 1) % len(ring)]]))))
            continue
        out.append((ring[best - 1], ring[best], ring[(best + 1) % len(ring)]))
        ring.pop(best)
        last = best + 1  # on to the next corner but one, so that ears don't fan out from one corner
    if len(ring) == 3 and _turn(*(at[i] for i in ring)) > 0:
        out.append(tuple(ring))
    return at, out


def prism(parts: Sequence[Sequence[Place]], low: float, high: float) -> tuple[list[tuple[float, float, float]], list[tuple[int, int, int]]]:
    """Vertices and faces, outwards, of the closed body over a polygon between two heights."""
    at, tops = triangulated(parts)
    n = len(at)
    vertices = [(x, y, high) for x, y in at] + [(x, y, low) for x, y in at]
    faces = [*tops, *((a + n, c + n, b + n) for a, b, c in tops)]
    first = 0
    for k, part in enumerate(parts):
        m = len(part)
        for i in range(m):
            p, q = first + i, first + (i + 1) % m
            faces += [(p, p + n, q + n), (p, q + n, q)]
        first += m
    return vertices, faces


def simplified(ring: Sequence[Place], tolerance: float) -> list[Place]:
    """The corners of a closed ring that a tolerance keeps: each half, between two corners far apart, for itself."""
    if tolerance <= 0 or len(ring) < 5:
        return list(ring)
    x, y = (np.array(v, float) for v in zip(*ring, strict=True))
    a = int(np.argmin(x + 1e-9 * y))
    x, y = np.roll(x, -a), np.roll(y, -a)
    b = int(np.argmax(np.hypot(x - x[0], y - y[0])))
    keep = np.zeros(len(x), bool)
    keep[: b + 1] |= kept_by_tolerance(x[: b + 1], y[: b + 1], tolerance)
    back = kept_by_tolerance(np.append(x[b:], x[0]), np.append(y[b:], y[0]), tolerance)
    keep[b:] |= back[:-1]
    out = [(float(p), float(q)) for p, q in zip(x[keep], y[keep], strict=True)]
    return out if len(out) >= 3 else list(ring)


def footprints(points: DataFrame, cell: float, close: bool = True) -> DataFrame:
    """row, col, region of the cells under building points (x, y); with `close`, also of cells that such cells surround from two
    sides or more, by a 3 x 3 closing."""
    own = saved(points.select(cell_of("y", cell).alias("row"), cell_of("x", cell).alias("col")).distinct())
    if close:
        wide = neighbours8(own.withColumn("z", F.lit(1.0))).select("row", "col").distinct()
        full = neighbours8(saved(wide).withColumn("z", F.lit(1.0))).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where("n = 9")
        own = full.select("row", "col").union(own).distinct()
    return regions(own.withColumn("class", F.lit(1))).select("row", "col", "region")


ROOFS = {"median": lambda z: F.percentile(z, F.lit(0.5)), "p90": lambda z: F.percentile(z, F.lit(0.9)), "max": F.max}


def _bodies(tolerance: float):
    """Rows of regions (region, ground, roof, xs, ys: the rings' corners, outer ring first) to their bodies, thousands at a time."""

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for region, ground, roof, xs, ys in batch[["region", "ground", "roof", "xs", "ys"]].itertuples(index=False, name=None):
                parts = [simplified(list(zip(x.tolist(), y.tolist(), strict=True)), tolerance) for x, y in zip(xs, ys, strict=True)]
                parts = [p[::-1] if (_twice_area(p) < 0 if k == 0 else _twice_area(p) > 0) else p for k, p in enumerate(parts)]
                vertices, faces = prism(parts, ground, roof)
                points = [{"x": x, "y": y, "z": z} for x, y, z in vertices]
                out.append((region, sum(map(_twice_area, parts)) / 2, points, [{"a": a, "b": b, "c": c} for a, b, c in faces]))
            yield pd.DataFrame(out, columns=["region", "area", "vertices", "faces"])

    return bodies


def building_models(points: DataFrame, cell: float = 0.5, min_area: float = 20.0, tolerance: float = 0.75, roof: str = "median", building: int = 6, ground: int = 2, close: bool = True, reach: float = 5.0, min_points: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Buildings (region, points, footprint, ground, roof, height, volume, corners), and their bodies as one mesh: vertices (mesh_id,
    vid, x, y, z) and faces (mesh_id, fid, a, b, c); mesh_id is the region.

    points: point_id, x, y, z, classification. Ground is the median of ground points within `reach` of the footprint's box, else
    the second percentile of the building's own points. Holes of footprints stay open. Footprints under min_area and buildings of
    fewer than min_points are left out.
    """
    own = points.where((F.col("classification") == building) & F.col("z").isNotNull() & ~F.isnan("z"))
    cells = saved(footprints(own, cell, close))
    large = cells.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("col").alias("c1"), F.max("col").alias("c2")).where(F.col("n") * cell * cell >= min_area)
    keyed = own.select("z", cell_of("y", cell).alias("row"), cell_of("x", cell).alias("col"))
    roofs = keyed.join(cells, ["row", "col"]).groupBy("region").agg(F.count(F.lit(1)).alias("points"), ROOFS[roof](F.col("z")).alias("roof"), F.percentile("z", F.lit(0.02)).alias("lowest"))
    found = saved(large.join(roofs.where(F.col("points") >= min_points), "region"))
    size = max(32 * cell, 4 * reach)
    box = {"x1": F.col("c1") * cell - reach, "x2": (F.col("c2") + 1) * cell + reach, "y1": F.col("r1") * cell - reach, "y2": (F.col("r2") + 1) * cell + reach}
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}1") / size), F.floor(F.col(f"{c}2") / size)))
    near = found.select("region", *[e.alias(n) for n, e in box.items()]).withColumn("bx", span("x")).withColumn("by", span("y"))
    below = points.where((F.col("classification") == ground) & F.col("z").isNotNull()).select("x", "y", "z", F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"))
    level = below.join(near, ["bx", "by"]).where("x between x1 and x2 and y between y1 and y2").groupBy("region").agg(F.percentile("z", F.lit(0.5)).alias("level"))
    heights = saved(found.join(level, "region", "left").select("region", "points", "roof", F.coalesce("level", "lowest").alias("ground")).where("roof > ground"))
    _, corners = rings(cells.join(heights.select("region"), "region", "left_semi"), cell)
    rows = corners.join(heights.select("region", "ground", "roof"), "region").withColumn("hole", ~F.col("outer"))
    body = "region long, area double, vertices array<struct<x: double, y: double, z: double>>, faces array<struct<a: long, b: long, c: long>>"
    # corners are few bytes but much work, so their partitions, whose number is given, aren't coalesced
    rows = rows.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "region")
    ring = rows.groupBy("region", "ground", "roof", "hole", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    parts = ring.groupBy("region", "ground", "roof").agg(F.sort_array(F.collect_list(F.struct("hole", "ring", "p"))).alias("r"))
    sides = [F.transform("r", lambda r: r["p"]["x"]).alias("xs"), F.transform("r", lambda r: r["p"]["y"]).alias("ys")]
    bodies = saved(parts.select("region", F.col("ground").cast("double").alias("ground"), F.col("roof").cast("double").alias("roof"), *sides).mapInPandas(_bodies(tolerance), body))
    vertices = bodies.select(F.col("region").alias("mesh_id"), F.posexplode("vertices").alias("vid", "p")).select("mesh_id", F.col("vid").cast("long").alias("vid"), "p.*")
    faces = bodies.select(F.col("region").alias("mesh_id"), F.posexplode("faces").alias("fid", "t")).select("mesh_id", F.col("fid").cast("long").alias("fid"), "t.*")
    height = F.col("roof") - F.col("ground")
    facts = heights.join(bodies.select("region", "area", F.size("vertices").alias("n")), "region")
    facts = facts.select("region", "points", F.col("area").alias("footprint"), "ground", "roof", height.alias("height"), (F.col("area") * height).alias("volume"), (F.col("n") / 2).cast("int").alias("corners"))
    return facts, vertices, faces
