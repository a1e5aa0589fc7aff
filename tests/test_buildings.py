from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bathyal.operators import buildings, mesh


def area(ring):
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
COMB = [(0, 0), (9, 0), (9, 6), (8, 6), (8, 1), (6, 1), (6, 6), (5, 6), (5, 1), (3, 1), (3, 6), (2, 6), (2, 1), (0, 1)]
STAR = [(math.cos(k * math.pi / 7) * (10 if k % 2 else 3), math.sin(k * math.pi / 7) * (10 if k % 2 else 3)) for k in range(14)]


@pytest.mark.parametrize("parts", [[SQUARE], [SQUARE[::-1]], [COMB], [STAR], [SQUARE, [(2, 2), (4, 2), (4, 4), (2, 4)]], [SQUARE, [(2, 2), (2, 4), (4, 4), (4, 2)], [(6, 5), (8, 5), (8, 8), (6, 8)], [(5, 1), (6, 1), (5.5, 2)]], [[(0, 0), (5, 0), (10, 0), (10, 5), (10, 10), (0, 10)]]])
def test_triangles_fill_polygons_with_holes(parts):
    at, found = buildings.triangulated(parts)
    want = area(parts[0]) - sum(area(h) for h in parts[1:])
    sizes = [(at[b][0] - at[a][0]) * (at[c][1] - at[a][1]) - (at[b][1] - at[a][1]) * (at[c][0] - at[a][0]) for a, b, c in found]
    assert min(sizes) > 0 and sum(sizes) / 2 == pytest.approx(want)
    for t in ((0.3, 0.3, 0.4), (0.1, 0.8, 0.1)):  # no triangle reaches into a hole
        for a, b, c in found:
            x, y = (sum(w * at[i][k] for w, i in zip(t, (a, b, c), strict=True)) for k in (0, 1))
            for h in parts[1:]:
                inside = sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(h, [*h[1:], h[0]], strict=True)) % 2
                assert not inside


@pytest.mark.parametrize("parts", [[SQUARE], [COMB], [SQUARE, [(2, 2), (2, 4), (4, 4), (4, 2)]]])
def test_prisms_are_closed_and_hold_their_volume(spark, parts):
    vertices, faces = buildings.prism(parts, 1.0, 4.0)
    v = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(vertices)], "mesh_id int, vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, k, *t) for k, t in enumerate(faces)], "mesh_id int, fid long, a long, b long, c long")
    assert mesh.boundary_edges(f).count() == 0
    assert mesh.volume(f, v).first().volume == pytest.approx(3 * (area(parts[0]) - sum(area(h) for h in parts[1:])))


def scene(spark):
    """Ground with a gentle slope, a plain block, a court with an open middle, and a shed too small to count."""
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 80, 12000), rng.uniform(0, 60, 12000)
    block = (x > 10) & (x < 22) & (y > 10) & (y < 20)
    court = (x > 40) & (x < 64) & (y > 10) & (y < 40) & ~((x > 48) & (x < 56) & (y > 18) & (y < 32))
    shed = (x > 10) & (x < 13) & (y > 40) & (y < 43)
    z = 5 + 0.0 * x
    z = np.where(block, 13.0, np.where(court, 17.0, np.where(shed, 8.0, z))) + rng.normal(0, 0.02, len(x))
    kind = np.where(block | court | shed, 6, 2)
    return spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(x)), "x": x, "y": y, "z": z, "classification": kind}))


def test_buildings_of_a_scene(spark):
    facts, vertices, faces = buildings.building_models(scene(spark), cell=1.0, min_area=20.0, tolerance=0.5)
    rows = facts.orderBy("footprint").collect()
    assert len(rows) == 2
    block, court = rows
    assert block.footprint == pytest.approx(120, rel=0.08) and court.footprint == pytest.approx(24 * 30 - 8 * 14, rel=0.08)
    assert block.height == pytest.approx(8, abs=0.1) and court.height == pytest.approx(12, abs=0.1) and block.ground == pytest.approx(5, abs=0.05)
    volume = {r.mesh_id: r.volume for r in mesh.volume(faces, vertices).collect()}
    assert mesh.boundary_edges(faces).count() == 0
    assert all(volume[r.region] == pytest.approx(r.volume) and r.volume == pytest.approx(r.footprint * r.height) for r in rows)
    assert court.corners >= 8


def test_no_ground_no_buildings_and_missing_heights(spark):
    p = scene(spark)
    alone, _, _ = buildings.building_models(p.where("classification = 6").withColumn("z", F.col("z") - F.when(F.col("point_id") % 10 == 0, 4).otherwise(0)), 1.0, 20.0)
    assert {round(r.ground) for r in alone.collect()} == {9, 13}
    facts, v, f = buildings.building_models(p.where("classification = 2"), 1.0)
    assert facts.count() == 0 and v.count() == 0 and f.count() == 0
    facts, _, _ = buildings.building_models(p.withColumn("z", F.lit(None).cast("double")), 1.0)
    assert facts.count() == 0


def test_bodies_are_made_by_the_batch_in_all_tasks(spark, monkeypatch):
    """No group in Python for each region, and partitions that few bytes don't coalesce; bodies are those of their footprints."""
    seen = []
    saved = buildings.saved
    monkeypatch.setattr(buildings, "saved", lambda df: (seen.append(df), saved(df))[1])
    i = np.arange(6400)
    x, y = (i % 80) * 1.0 + 0.5, (i // 80) * 1.0 + 0.5
    block = (x % 8 < 5) & (y % 8 < 5) & ~((x % 8 > 2) & (x % 8 < 3) & (y % 8 > 2) & (y % 8 < 3) & (x > 40))  # half of them have a court
    points = spark.createDataFrame(pd.DataFrame({"point_id": i, "x": x, "y": y, "z": np.where(block, 7.0, 1.0), "classification": np.where(block, 6, 2)}))
    facts, vertices, faces = buildings.building_models(points, 1.0, 4.0, 0.0, close=False, min_points=1)
    volume = {r.mesh_id: r.volume for r in mesh.volume(faces, vertices).collect()}
    rows = facts.collect()
    assert sorted(r.footprint for r in rows) == [24.0] * 50 + [25.0] * 50 and all(volume[r.region] == pytest.approx(6 * r.footprint) for r in rows)
    plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    assert seen[-1].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
