from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bathyal.operators import mesh, tin


def frame(spark, x, y, z=None):
    n = len(x)
    return spark.createDataFrame(pd.DataFrame({"point_id": np.arange(n) * 7 + 3, "x": np.asarray(x, float), "y": np.asarray(y, float), "z": np.zeros(n) if z is None else np.asarray(z, float)}), "point_id long, x double, y double, z double")


def corners(faces):
    return sorted(tuple(sorted((i - 3) // 7 for i in (r.a, r.b, r.c))) for r in faces.collect())


def brute(x, y):
    """All triples with nothing in their circle."""
    out = []
    for t in itertools.combinations(range(len(x)), 3):
        cx, cy, r = tin.circles(x, y, np.array([t]))
        others = np.setdiff1d(np.arange(len(x)), t)
        if np.isfinite(r[0]) and (np.hypot(x[others] - cx, y[others] - cy) > r[0]).all():
            out.append(t)
    return sorted(out)


@pytest.mark.parametrize("n", [3, 4, 6, 20])
def test_kernel_against_all_triples(n):
    rng = np.random.default_rng(n)
    for _ in range(5):
        x, y = rng.random(n), rng.random(n)
        got = tin.delaunay(x, y)
        assert sorted(tuple(sorted(t)) for t in got.tolist()) == brute(x, y)
        assert ((x[got[:, 1]] - x[got[:, 0]]) * (y[got[:, 2]] - y[got[:, 0]]) > (y[got[:, 1]] - y[got[:, 0]]) * (x[got[:, 2]] - x[got[:, 0]])).all()


def test_tiles_give_the_triangles_of_the_whole(spark):
    """Even points, dense clusters far apart and thin tracks with wide gaps, over leaves much smaller than the whole."""
    rng = np.random.default_rng(1)
    even = rng.random(600) * 100, rng.random(600) * 60
    clusters = np.concatenate([rng.normal(0, 1, 200), rng.normal(0, 0.001, 200), rng.random(60) * 100 + 50]), np.concatenate([rng.normal(0, 1, 200), rng.normal(0, 0.001, 200), rng.random(60)])
    tracks = np.tile(np.arange(100.0), 4) + rng.random(400) * 0.1, np.repeat(np.arange(4) * 40.0, 100) + rng.random(400) * 0.1
    for x, y in (even, clusters, tracks):
        want = sorted(tuple(sorted(t)) for t in tin.delaunay(x, y).tolist())
        v, f = tin.build_tin(frame(spark, x, y), leaf_points=50)
        assert corners(f) == want and tin.delaunay_faults(v, f).count() == 0


def test_small_sets_against_all_triples_across_borders(spark):
    rng = np.random.default_rng(5)
    x, y = rng.random(18), rng.random(18)
    assert corners(tin.build_tin(frame(spark, x, y), leaf_points=3)[1]) == brute(x, y)


def test_stars_find_most_triangles_and_no_wrong_one():
    """Even points, moved lattices, clusters and tracks: stars give triangles of the whole, and settle the rest with them."""
    rng = np.random.default_rng(4)
    whole = (-math.inf, -math.inf, math.inf, math.inf)
    gx, gy = (g.ravel() + rng.random(g.size) * 1e-8 for g in np.meshgrid(np.arange(60.0), np.arange(40.0)))
    clusters = np.concatenate([rng.normal(0, 1, 900), rng.normal(0, 0.001, 900)]), np.concatenate([rng.normal(0, 1, 900), rng.normal(0, 0.001, 900)])
    tracks = np.tile(np.arange(500.0), 4) + rng.random(2000) * 0.1, np.repeat(np.arange(4) * 40.0, 500) + rng.random(2000) * 0.1
    for (x, y), share in (((rng.random(4000) * 100, rng.random(4000) * 60), 0.9), ((gx, gy), 0.9), (clusters, 0), (tracks, 0), (tracks[::-1], 0)):
        turned = lambda rows: {tuple(np.roll(r, -int(np.argmin(r))).tolist()) for r in rows}
        want, found = turned(tin.delaunay(x, y)), turned(tin.stars(x, y, whole))
        assert found <= want and len(found) >= share * len(want)
        assert turned(tin.settle(x, y, set(), whole)[0]) == want


def test_stars_need_their_circles_within_the_box():
    rng = np.random.default_rng(6)
    x, y = rng.random(3000) * 10, rng.random(3000) * 10
    inner = (x > 3) & (x < 7) & (y > 2) & (y < 8)
    ids = np.flatnonzero(inner)
    found = ids[tin.stars(x[inner], y[inner], (3.0, 2.0, 7.0, 8.0))]
    want = {tuple(sorted(t)) for t in tin.delaunay(x, y).tolist()}
    assert len(found) > 1000 and {tuple(sorted(t)) for t in found.tolist()} <= want


def test_placed_faces_are_those_of_the_mesh(spark):
    rng = np.random.default_rng(7)
    points = frame(spark, rng.random(300) * 9, rng.random(300) * 9, rng.random(300))
    v, f = tin.build_tin(points, max_edge=2.0, leaf_points=40)
    placed = tin.placed_faces(points, max_edge=2.0, leaf_points=40)
    names = ["fid", "a", "b", "c", *tin.PLACES]
    assert sorted(mesh.corners(f, v).select(names).collect()) == sorted(placed.select(names).collect())
    cells = lambda faces, vertices: sorted(mesh.rasterize(faces, vertices, 0.7).collect())
    assert cells(placed, None) == cells(f, v)


def test_tin_limited_joins_no_corners(spark, sf):
    """Faces bring the places of their corners, so nothing is joined after the triangulation."""
    from bathyal.plans.tin import tin_limited

    found = tin_limited(spark, sf)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.first().faces > 0


def test_lattices_copies_and_points_that_take_no_part(spark):
    gx, gy = (g.ravel() for g in np.meshgrid(np.arange(20.0), np.arange(15.0)))
    x, y = np.concatenate([gx, gx[:50], [np.nan, np.inf]]), np.concatenate([gy, gy[:50], [1.0, 2.0]])
    v, f = tin.build_tin(frame(spark, x, y), leaf_points=20)
    assert f.count() == 2 * 19 * 14 and mesh.face_areas(f, v).agg(F.sum("area")).first()[0] == pytest.approx(19 * 14)
    assert tin.delaunay_faults(v, f).count() == 0 and mesh.boundary_edges(f).count() == 2 * (19 + 14)
    again = tin.build_tin(frame(spark, x, y).repartition(7), leaf_points=1000)[1]
    assert corners(again) == corners(f)  # neither partitions nor leaves matter


@pytest.mark.parametrize("x, y", [([], []), ([1], [1]), ([1, 1], [2, 2]), ([0, 1, 2, 3], [0, 1, 2, 3]), ([5, 5, 5], [0, 1, 7])])
def test_too_few_points_or_one_line(spark, x, y):
    assert tin.build_tin(frame(spark, x, y))[1].count() == 0


def test_longest_edge_and_faults(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random(200) * 10, rng.random(200) * 10
    want = [t for t in tin.delaunay(x, y).tolist() if max(math.hypot(x[p] - x[q], y[p] - y[q]) for p, q in itertools.combinations(t, 2)) <= 1.2]
    assert corners(tin.build_tin(frame(spark, x, y), max_edge=1.2, leaf_points=30)[1]) == sorted(tuple(sorted(t)) for t in want)
    v = frame(spark, [0, 4, 4, 0], [0, 0, 1, 1.5]).select(F.lit(0).alias("mesh_id"), F.col("point_id").alias("vid"), "x", "y", "z")
    wrong = spark.createDataFrame([(0, 1, 3, 10, 24), (0, 2, 10, 17, 24)], "mesh_id int, fid long, a long, b long, c long")
    assert tin.delaunay_faults(v, wrong).count() == 1


def section(spark, points, lines, leaf=30, size=1.0, max_edge=0.0):
    v, f = tin.build_tin(points, max_edge, leaf)
    rows = [(name, k, float(p[0]), float(p[1])) for name, line in lines.items() for k, p in enumerate(line)]
    return tin.tin_section(v, f, spark.createDataFrame(rows, "line_id string, seq int, x double, y double"), size)


def test_section_of_a_plane_is_whole_and_in_order(spark):
    rng = np.random.default_rng(3)
    x, y = np.concatenate([rng.random(300) * 100, [0, 100, 0, 100]]), np.concatenate([rng.random(300) * 100, [0, 0, 100, 100]])
    lines = {"a": [(-20, 50), (130, 51)], "b": [(10, 10), (60, 80), (60, 80), (61, 20.5)], "outside": [(200, 200), (300, 300)]}
    rows = section(spark, frame(spark, x, y, 2 * x - y + 5), lines).collect()
    for name, first, last in (("a", 20, None), ("b", 0, math.hypot(50, 70) + math.hypot(1, 59.5))):
        own = sorted((r for r in rows if r.line_id == name), key=lambda r: r.ch0)
        assert [r.joined for r in own] == [False] + [True] * (len(own) - 1)
        assert own[0].ch0 == pytest.approx(first * math.hypot(150, 1) / 150 if name == "a" else 0, abs=1e-6)
        assert all(p.ch1 == pytest.approx(q.ch0, abs=1e-6) and p.z1 == pytest.approx(q.z0, abs=1e-6) for p, q in itertools.pairwise(own))
        if last:
            assert own[-1].ch1 == pytest.approx(last)
    one = [r for r in rows if r.line_id == "a"]
    for r in one:
        t = r.ch0 / math.hypot(150, 1)
        assert r.z0 == pytest.approx(2 * (-20 + 150 * t) - (50 + t) + 5, abs=1e-6)
    assert not [r for r in rows if r.line_id == "outside"]


def test_section_with_gaps_and_along_edges(spark):
    """Two squares with a gap between them; lines along sides and diagonals count each stretch once."""
    x, y = [0, 1, 1, 0, 3, 4, 4, 3], [0, 0, 1, 1, 0, 0, 1, 1]
    lines = {"cross": [(-1, 0.3), (5, 0.3)], "side": [(0, 0), (1, 0)], "up": [(1, 0), (1, 1)], "diagonals": [(0, 0), (1, 1), (0, 1), (1, 0)]}
    rows = section(spark, frame(spark, x, y, x), lines, size=0.3, max_edge=1.5).collect()
    total = {k: sum(r.ch1 - r.ch0 for r in rows if r.line_id == k) for k in lines}
    assert total == pytest.approx({"cross": 2, "side": 1, "up": 1, "diagonals": 1 + 2 * math.sqrt(2)})
    cross = sorted((r for r in rows if r.line_id == "cross"), key=lambda r: r.ch0)
    assert [r.joined for r in cross].count(False) == 2
    assert all(r.z0 == pytest.approx(r.ch0 - 1) and r.z1 == pytest.approx(r.ch1 - 1) for r in cross)


def test_section_meets_large_and_small_triangles(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.random(100), [-5000, 5000, 0, 0]])
    y = np.concatenate([rng.random(100), [0, 0, 5000, -5000]])
    rows = section(spark, frame(spark, x, y, x + y), {"l": [(-4000, 10), (4000, 11)]}, size=0.1).collect()
    own = sorted(rows, key=lambda r: r.ch0)
    assert sum(r.ch1 - r.ch0 for r in own) == pytest.approx(math.hypot(8000, 1)) and [r.joined for r in own].count(False) == 1


def test_four_points_nearly_on_a_circle_over_a_large_extent(spark):
    """Whole coordinates that span 900,000: the triangles are those of the places themselves, not only of the moved ones."""
    rng = np.random.default_rng(3)
    gx, gy = (g.ravel().astype(float) for g in np.mgrid[0:80, 0:80])
    x, y = [], []
    while len(x) < 400:
        p = rng.integers(0, 80, (3, 2)).astype(float)
        (ax, ay), (bx, by), (cx, cy) = [(q[0] - gx, q[1] - gy) for q in p]
        n = [u * u + v * v for u, v in ((ax, ay), (bx, by), (cx, cy))]
        det = np.abs(n[0] * (bx * cy - cx * by) - n[1] * (ax * cy - cx * ay) + n[2] * (ax * by - bx * ay))
        fourth = np.flatnonzero((det >= 1) & (det <= 5))
        if abs(np.linalg.det(np.column_stack([p, np.ones(3)]))) > 1500 and len(fourth):
            x += [*p[:, 0], gx[fourth[0]]]
            y += [*(p[:, 1] + 9000 * (len(y) // 4)), gy[fourth[0]] + 9000 * (len(y) // 4)]
    v, f = tin.build_tin(frame(spark, x, y))
    assert tin.delaunay_faults(v, f).count() == 0
