from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bathyal.functions import expressions
from bathyal.operators import points
from bathyal.operators.graph import counted_off
from bathyal.sources import vector


def wave(n):
    return [(i * 0.5, math.sin(i / 9) * 20) for i in range(n)]


def test_long_lines_and_rings_as_short_ones(spark, monkeypatch):
    """A walked literal gives what the unrolled expression gives; its plan doesn't grow."""
    rng = np.random.default_rng(0)
    frame = spark.createDataFrame(pd.DataFrame({"x": rng.random(80) * 40 - 5, "y": rng.random(80) * 60 - 30}))
    line = [*wave(50), wave(50)[-1], (3.0, 40.0)]
    found = lambda: frame.select("x", expressions.segment_offsets(F.col("x"), F.col("y"), line).alias("s"), expressions.in_polygon(F.col("x"), F.col("y"), [*line, line[0]]).alias("p")).orderBy("x").collect()
    short = found()
    monkeypatch.setattr(expressions, "UNROLLED", 5)
    assert found() == short and sum(r.p for r in short) > 5


def test_a_line_of_ten_thousand_vertices(spark):
    frame = spark.createDataFrame([(2500.25, 3.0)], "x double, y double")
    got = frame.select(expressions.segment_offsets(F.col("x"), F.col("y"), wave(10_000)).alias("s")).first().s
    assert got.dist == pytest.approx(min(math.hypot(2500.25 - x, 3 - y) for x, y in [(a[0] + (b[0] - a[0]) * t / 50, a[1] + (b[1] - a[1]) * t / 50) for a, b in zip(wave(10_000), wave(10_000)[1:], strict=False) for t in range(51)]), abs=0.01)


def test_corridors_of_long_lines_meet_by_buckets(spark, monkeypatch):
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(500), "x": rng.random(500) * 120 - 5, "y": rng.random(500) * 60 - 30, "dist": 7.0})).drop("dist")
    line = [*wave(200), (300.0, 0.0)]
    frame = frame.union(frame.limit(20))  # rows that repeat stay twice
    bucketed = sorted(tuple(r) for r in points.corridor_points(frame, line, 4.0).collect())
    monkeypatch.setattr(points, "UNROLLED", 10**9)
    walked = sorted(tuple(r) for r in points.corridor_points(frame, line, 4.0).collect())
    assert len(walked) > 100 and np.allclose(np.array(bucketed), np.array(walked))


def features(spark, rows):
    return spark.createDataFrame([(t, [[{"x": float(p[0]), "y": float(p[1]), "z": float(p[2]) if len(p) > 2 else None} for p in part] for part in parts], attrs) for t, parts, attrs in rows], vector.SCHEMA)


def test_one_route_for_each_line(spark):
    rows = [
        ("LineString", [[(0, 0), (1, 0)]], {"name": "a"}), ("LineString", [[(5, 5), (6, 6)]], {"name": "a"}), ("LineString", [[(0, 1), (1, 1)]], {"name": "b"}),
        ("LineString", [[(0, 2), (1, 2)]], {}), ("Point", [[(9, 9)]], {"name": "p"}), ("LineString", [[(0, 3), (1, 3)], [(4, 3), (5, 3)]], {"name": ""}),
    ]
    for parts in (1, 3, 8):
        got = vector.routes_from_features(features(spark, rows).coalesce(1) if parts == 1 else features(spark, rows).repartitionByRange(parts, F.col("parts")[0][0]["y"]), base="leg")
        routes = {}
        for r in got.orderBy("route_id", "seq").collect():
            routes.setdefault(r.route_id, []).append((r.x, r.y))
        assert len(routes) == 6 and all(len(v) == 2 for v in routes.values())
        assert routes["b"] == [(0, 1), (1, 1)] and sum(k.startswith("a #") for k in routes) == 2 and sum(k.startswith("leg ") for k in routes) == 3
    named = vector.routes_from_features(features(spark, rows).coalesce(1), base="leg").select("route_id").distinct()
    assert sorted(r[0] for r in named.collect()) == ["a #1", "a #2", "b", "leg 4", "leg 5", "leg 6"]


def test_routes_of_points(spark):
    point = lambda x, kp, name="R", **more: ("Point", [[(x, 0, -x)]], {"name": name, "kp": kp} | more)
    rows = [point(1, "0,3"), point(2, "0.1"), point(3, "0.2"), point(4, "1", "S"), point(5, "x", "S"), point(6, "0.5", "alone"), point(7, "0.4", dob="1,5", seabed="20")]
    got = vector.routes_from_points(features(spark, rows).coalesce(1), kp="kp", dob="dob").orderBy("route_id", "seq").collect()
    assert [(r.route_id, r.seq, r.x, r.kp) for r in got] == [("R", 0, 2, 0.1), ("R", 1, 3, 0.2), ("R", 2, 1, 0.3), ("R", 3, 7, 0.4), ("S", 0, 4, None), ("S", 1, 5, None)]
    assert [r.z for r in got] == [-2, -3, -1, -7, -4, -5] and got[3].dob == 1.5
    below = vector.routes_from_points(features(spark, rows).coalesce(1), kp="kp", z=None, dob="dob", seabed="seabed", seabed_depth=True).where("x = 7").first()
    assert below.z == -21.5
    assert vector.routes_from_points(features(spark, rows), name=None).select("route_id").distinct().collect() == [("route",)]


def test_guessed_fields(spark):
    rows = [("Point", [[(0, 0)]], {"Route_Name": "a", "KP": "1", "burial depth": "1", "WD": "3", "Cable depth (m)": "4"})]
    assert vector.guess_fields(features(spark, rows)) == {"name": "Route_Name", "kp": "KP", "dob": "burial depth", "seabed": "WD", "z": "Cable depth (m)", "z_depth": True}
    rows.append(("LineString", [[(0, 0, 5), (1, 1, 5)]], {}))
    assert vector.guess_fields(features(spark, rows))["z"] == "geometry" and not vector.guess_fields(features(spark, rows))["z_depth"]
    assert vector.find_field([], ("kp",)) is None


def test_counting_off(spark):
    frame = spark.range(0, 1000, 1, 7)
    assert sorted((r.k, r.id) for r in counted_off(frame).collect()) == [(i + 1, i) for i in range(1000)]
    assert counted_off(spark.range(0)).count() == 0
