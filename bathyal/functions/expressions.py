"""Column expressions that several operators share."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reject classes, and the factor between one standard deviation and 95 %.
REJECTED = (7, 18)
SIGMA_95 = 1.96


def cell(value: Column | str, size: float, origin: float = 0.0) -> Column:
    """The number of the cell that holds a coordinate."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor((value - origin) / size).cast("long")


#: Lines and rings of more segments than this are one literal array that an expression walks, so that plans stay small.
UNROLLED = 64


def _literal(rows: Sequence[Sequence[float]], fields: Sequence[str]) -> Column:
    """An array of structs of doubles as a constant of the plan, whatever its length."""
    values = [dict(zip(fields, map(float, r), strict=True)) for r in rows]
    return F.from_json(F.lit(json.dumps(values)), f"array<struct<{', '.join(f'{f}: double' for f in fields)}>>")


def in_polygon(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Even-odd test. A last vertex equal to the first is dropped."""
    ring = list(ring[:-1]) if len(ring) > 1 and tuple(ring[0]) == tuple(ring[-1]) else list(ring)
    if len(ring) > UNROLLED:
        sides = [(x1, y1, x2, y2) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]) if y1 != y2]

        def crossed(inside: Column, s: Column) -> Column:
            at = (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]
            return inside != (((s["y1"] > y) != (s["y2"] > y)) & (x < at))

        return F.aggregate(_literal(sides, ("x1", "y1", "x2", "y2")), F.lit(False), crossed)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            at = (F.lit(float(x2)) - float(x1)) * (y - float(y1)) / (float(y2) - float(y1)) + float(x1)
            crossings = crossings + (((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < at)).cast("int")
    return crossings % 2 == 1


def segment_offsets(x: Column, y: Column, line: Sequence[tuple[float, float]]) -> Column:
    """Of the nearest segment of a polyline: dist, seg, ch (chainage) and off (signed, right positive). The first nearest wins."""
    if len(line) > UNROLLED + 1:
        return _walked_offsets(x, y, line)
    cum, parts = 0.0, []
    for i, ((x1, y1), (x2, y2)) in enumerate(zip(line, line[1:])):
        length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        if length == 0:
            continue
        ux, uy = (x2 - x1) / length, (y2 - y1) / length
        along = F.least(F.lit(length), F.greatest(F.lit(0.0), (x - x1) * ux + (y - y1) * uy))
        dx, dy = x - (x1 + along * ux), y - (y1 + along * uy)
        across = (x - x1) * uy - (y - y1) * ux
        parts.append(
            F.struct(F.sqrt(dx * dx + dy * dy).alias("dist"), F.lit(i).alias("seg"), (along + cum).alias("ch"), across.alias("off"))
        )
        cum += length
    return F.array_min(F.array(*parts))


def _walked_offsets(x: Column, y: Column, line: Sequence[tuple[float, float]]) -> Column:
    """segment_offsets of a long line."""
    cum, rows = 0.0, []
    for i, ((x1, y1), (x2, y2)) in enumerate(zip(line, line[1:])):
        if length := ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5:
            rows.append((x1, y1, (x2 - x1) / length, (y2 - y1) / length, length, cum, i))
            cum += length
    none = F.lit(None).cast("struct<dist: double, seg: int, ch: double, off: double>")

    def nearer(best: Column, s: Column) -> Column:
        along = F.least(s["length"], F.greatest(F.lit(0.0), (x - s["x1"]) * s["ux"] + (y - s["y1"]) * s["uy"]))
        dx, dy = x - (s["x1"] + along * s["ux"]), y - (s["y1"] + along * s["uy"])
        dist = F.sqrt(dx * dx + dy * dy)
        own = F.struct(dist.alias("dist"), s["i"].cast("int").alias("seg"), (along + s["cum"]).alias("ch"), ((x - s["x1"]) * s["uy"] - (y - s["y1"]) * s["ux"]).alias("off"))
        return F.when(best.isNotNull() & (best["dist"] <= dist), best).otherwise(own)

    return F.aggregate(_literal(rows, ("x1", "y1", "ux", "uy", "length", "cum", "i")), none, nearer)


def noise(classification: Column) -> Column:
    return F.coalesce(classification.isin(*REJECTED), F.lit(False))


def allowed_tvu(order: Column, depth: Column) -> Column:
    """The 95 % vertical uncertainty that an order (a struct with a and b) allows at a depth."""
    return F.sqrt(order["a"] * order["a"] + (order["b"] * depth) * (order["b"] * depth))


def round6(value: Column) -> Column:
    return F.round(value, 6)
