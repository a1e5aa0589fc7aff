from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bathyal.operators import areas, extraction, graph


def links(spark, pairs):
    return spark.createDataFrame(pairs, "id long, nxt long").repartition(3)


def test_chains_and_cycles(spark):
    """Open chains, one link alone, a link to itself, cycles of many lengths with ids in any order."""
    rng = np.random.default_rng(0)
    names = rng.permutation(200)
    pairs, at, want = [], 0, {}
    for n, cycle in ((1, False), (1, True), (2, True), (3, False), (7, True), (16, True), (31, False), (64, True)):
        own = [int(i) for i in names[at : at + n]]
        at += n
        pairs += [(i, own[k + 1] if k + 1 < n else (own[0] if cycle else None)) for k, i in enumerate(own)]
        start = own.index(min(own)) if cycle else 0
        own = own[start:] + own[:start]
        want |= {i: (own[-1], n - 1 - k, cycle) for k, i in enumerate(own)}
    got = {r.id: (r.chain, r.left, r.cycle) for r in graph.chained(links(spark, pairs)).collect()}
    assert got == want
    assert graph.chained(links(spark, [])).count() == 0


def flood(mask: np.ndarray) -> np.ndarray:
    """4-connected labels of equal values by flooding."""
    out, n = np.full(mask.shape, -1), 0
    for start in zip(*np.nonzero(mask >= 0), strict=True):
        if out[start] >= 0:
            continue
        todo = [start]
        while todo:
            r, c = todo.pop()
            if out[r, c] >= 0:
                continue
            out[r, c] = n
            todo += [(a, b) for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] == mask[r, c] and out[a, b] < 0]
        n += 1
    return out


def cells_of(spark, mask, r0=-3, c0=-5):
    return spark.createDataFrame([(int(r) + r0, int(c) + c0, int(mask[r, c])) for r, c in zip(*np.nonzero(mask >= 0), strict=True)], "row long, col long, class long")


def covered(parts, r0, c0, shape):
    """Cells whose centre lies within an odd number of rings."""
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]] + 0.5
    x, y = x + c0, y + r0
    inside = np.zeros(shape, bool)
    for ring in parts:
        for p, q in zip(ring, ring[1:], strict=False):
            cross = (p.y > y) != (q.y > y)
            inside ^= cross & (x < p.x)
    return inside


@pytest.mark.parametrize("seed, tile", [(0, 4), (1, 7), (2, 128)])
def test_regions_and_rings_of_random_classes(spark, seed, tile):
    """Labels as by flooding; polygons cover exactly the cells of their region, outer ring first, holes clockwise."""
    rng = np.random.default_rng(seed)
    mask = rng.integers(-1, 2, (17, 23))
    want = flood(mask)
    named = areas.regions(cells_of(spark, mask), tile).cache()
    got = np.full(mask.shape, -1, np.int64)
    for r in named.collect():
        got[r.row + 3, r.col + 5] = r["region"]
    pairs = set(zip(want.ravel().tolist(), got.ravel().tolist(), strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    facts, corners = areas.rings(named)
    assert [r.n for r in facts.groupBy("region").agg(F.count_if("outer").alias("n")).collect()] == [1] * (want.max() + 1)
    for row in areas.polygons(corners).collect():
        assert (covered(row.parts, -3, -5, mask.shape) == (got == row.region)).all()
        twice = [sum(p.x * q.y - q.x * p.y for p, q in zip(ring, ring[1:], strict=False)) for ring in row.parts]
        assert twice[0] > 0 and all(a < 0 for a in twice[1:]) and sum(twice) == 2 * (got == row.region).sum()
        assert all(abs((q.x - p.x) * (s.y - q.y) - (q.y - p.y) * (s.x - q.x)) > 0 for ring in row.parts for p, q, s in zip(ring, ring[1:], ring[2:], strict=False))


def test_one_long_ring(spark):
    """A snake of cells through many tiles: one region, one ring."""
    mask = np.full((20, 21), -1)
    mask[::2] = 1
    mask[1::4, -1] = 1
    mask[3::4, 0] = 1
    facts, corners = areas.rings(areas.regions(cells_of(spark, mask), 5), 2.0)
    row = facts.collect()
    assert len(row) == 1 and row[0].area == 4 * (mask > 0).sum() and row[0].length == 2 * (2 * (mask > 0).sum() + 2)


def test_outline_and_empty_tables(spark):
    mask = np.full((8, 9), -1)
    mask[1:5, 1:6] = 0
    mask[2, 3] = -1
    mask[6:8, 7:9] = 0
    got = areas.outline(cells_of(spark, mask, 0, 0), 0.5, 3).orderBy("seq").collect()
    points = [(r.x, r.y) for r in got]
    assert sorted(points) == [(0.5, 0.5), (0.5, 2.5), (3, 0.5), (3, 2.5)]
    assert sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True)) == 2 * 2.5 * 2
    empty = spark.createDataFrame([], "row long, col long, z double")
    facts, corners = areas.depth_areas(empty, 1.0)
    assert facts.count() == 0 and corners.count() == 0


def test_depth_areas_of_a_cone(spark):
    """Rings around a shoal: each area between two levels has the next shallower one as its hole."""
    y, x = np.mgrid[0:40, 0:40]
    depth = np.hypot(x - 20, y - 20) * 0.75 + 1
    surface = spark.createDataFrame([(int(r), int(c), float(-depth[r, c])) for r, c in zip(y.ravel(), x.ravel(), strict=True)], "row long, col long, z double")
    facts, corners = areas.depth_areas(surface, 2.0, (0, 2, 5, 10, 500), bias_cells=0, tile=16)
    rows = facts.orderBy("drval1").collect()
    assert [(r.drval1, r.drval2, r.holes) for r in rows] == [(1.0, 2.0, 0), (2.0, 5.0, 1), (5.0, 10.0, 1), (10.0, round(float(depth.max()), 2), 1)]
    assert all(r.area == r.cells * 4 for r in rows) and sum(r.area for r in rows) == 1600 * 4
    assert rows[1].cells == ((depth >= 2) & (depth < 5)).sum()
    assert corners.where("not outer").select("ring").distinct().count() == 3


def test_contour_lines_are_chained_without_a_group_per_line(spark):
    y, x = np.mgrid[0:30, 0:40]
    z = np.sin(x / 4.0) + np.cos(y / 5.0)
    surface = spark.createDataFrame([(int(r), int(c), float(z[r, c])) for r, c in zip(y.ravel(), x.ravel(), strict=True)], "row long, col long, z double")
    segments = extraction.contour_segments(surface, 1.0, [-0.5, 0.0, 0.5])
    lines = extraction.contour_lines(segments).collect()
    length = segments.agg(F.sum(F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2))).first()[0]
    steps = [math.hypot(p.x - q.x, p.y - q.y) for line in lines for p, q in zip(line.points, line.points[1:], strict=False)]
    assert sum(steps) == pytest.approx(length) and max(steps) < 1.5
    ends = [p for line in lines for p in (line.points[0], line.points[-1]) if line.points[0] != line.points[-1]]
    assert all(min(abs(p.x - 0.5), abs(p.x - 39.5), abs(p.y - 0.5), abs(p.y - 29.5)) < 1e-9 for p in ends)  # lines end on the border only


def test_oracle_of_depth_areas_floods_long_regions(spark, tmp_path):
    """A strip of 600 cells is one area in SQL too, however many steps apart its ends are."""
    import duckdb

    from bathyal.plans.areas import depth_areas
    from bathyal.plans.registry import ORACLES
    from oracle_check import rows

    orders = spark.range(600).selectExpr("id AS o_orderkey", "id * 50 AS o_custkey", "60000.0 + id AS o_totalprice", "timestamp'1992-01-05' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    orders.toPandas().astype({"o_totalprice": float}).to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    mine, other = depth_areas(spark, str(tmp_path)).toPandas(), db.sql(ORACLES["depth_areas"]).df()
    assert len(other) == 1 and other["cells"][0] == 600
    assert rows(mine[sorted(mine)]) == rows(other[sorted(other)])
