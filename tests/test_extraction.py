from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bathyal.functions import crs
from bathyal.operators import extraction
from bathyal.streaming import live_cells


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_contours_of_a_cone(spark):
    c = np.arange(60)
    col, row = (a.ravel() for a in np.meshgrid(c, c))
    x, y = (col + 0.5) * 0.5, (row + 0.5) * 0.5
    cone = frame(spark, row=row, col=col, z=-np.hypot(x - 15, y - 15))
    lines = extraction.contour_lines(extraction.contour_segments(cone, 0.5, [-5.0, -10.0])).collect()
    assert len(lines) == 2
    for line in lines:
        r = [math.hypot(p.x - 15, p.y - 15) for p in line.points]
        assert max(abs(v + line.level) for v in r) < 0.02 and line.points[0] == line.points[-1]
    length = spark.createDataFrame(lines).select("level", extraction.line_length(F.col("points")).alias("m")).collect()
    assert all(r.m == pytest.approx(-r.level * 2 * math.pi, rel=0.01) for r in length)


def test_utm_round_trip(spark):
    rows = frame(spark, lon=[121.5, 3.0, -71.1], lat=[25.03, 0.5, -33.4])
    for epsg, i in ((32651, 0), (32631, 1), (32719, 2)):
        e, n = crs.transform(F.col("lon"), F.col("lat"), 4326, epsg)
        lon, lat = crs.transform(F.col("e"), F.col("n"), epsg, 4326)
        r = rows.withColumns({"e": e, "n": n}).select("lon", "lat", "e", "n", lon.alias("lon2"), lat.alias("lat2"), crs.utm_epsg(F.col("lon"), F.col("lat")).alias("z")).collect()[i]
        assert r.lon2 == pytest.approx(r.lon, abs=1e-9) and r.lat2 == pytest.approx(r.lat, abs=1e-9) and r.z == epsg
    east = rows.select(*crs.utm(32631).forward(F.lit(3.0), F.lit(0.0))).first()  # on the central meridian at the equator
    assert east[0] == pytest.approx(500000) and east[1] == pytest.approx(0)


def test_cloud_distances(spark):
    rng = np.random.default_rng(0)
    p, q = rng.uniform(0, 10, (2, 4000, 2))
    a = frame(spark, point_id=np.arange(4000), x=p[:, 0], y=p[:, 1], z=rng.normal(0, 0.01, 4000))
    b = frame(spark, point_id=np.arange(4000), x=q[:, 0], y=q[:, 1], z=rng.normal(0.2, 0.01, 4000))
    core = a.where("x between 2 and 8 and y between 2 and 8").limit(50)
    got = extraction.cloud_distances(core, a, b, 2.0, 1.0, 1.0).collect()
    assert len(got) == 50 and all(r.significant and r.distance == pytest.approx(0.2, abs=0.03) for r in got)


def test_tracks_pairs_and_similarity(spark):
    matches = spark.createDataFrame([(0, 1, 1, 5), (1, 5, 2, 7), (0, 2, 1, 6), (1, 6, 0, 3)], "image_a long, feature_a long, image_b long, feature_b long")
    got = extraction.build_tracks(matches).collect()
    assert sorted((r.image, r.feature) for r in got) == [(0, 1), (1, 5), (2, 7)]
    pairs = extraction.select_pairs(spark.range(5).toDF("i"), 2).collect()
    assert sorted((r.a, r.b) for r in pairs) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    rng = np.random.default_rng(1)
    s = rng.normal(size=(40, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    t = 2.5 * s @ turn.T + (1, 2, 3)
    fit = extraction.similarity(frame(spark, **{f"s{c}": s[:, i] for i, c in enumerate("xyz")}, **{f"t{c}": t[:, i] for i, c in enumerate("xyz")}))
    assert fit["scale"] == pytest.approx(2.5) and np.allclose(fit["rotation"], turn) and np.allclose(fit["shift"], (1, 2, 3))


def test_live_cells_in_a_stream(spark, tmp_path):
    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"), (F.col("id") % 20).cast("double").alias("x"), F.lit(1.0).alias("y"), (-F.col("id") / 10).alias("z"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live_cells(stream, 5.0).writeStream.outputMode("complete").format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("cells").collect()}
    assert got == {tuple(r) for r in live_cells(rows, 5.0).collect()} and len(got) == 24


def test_simplified_lines_and_labels(spark):
    from bathyal.operators import contours

    rng = np.random.default_rng(3)
    x, y = np.arange(200.0), np.cumsum(rng.normal(0, 0.3, 200))
    kept = contours.kept_by_tolerance(x, y, 0.5)
    assert kept[0] and kept[-1] and kept.sum() < 100
    assert np.abs(np.interp(x, x[kept], y[kept]) - y).max() < 0.8  # 0.5 across the chords
    line = spark.createDataFrame([(5.0, [(float(i), 0.0) for i in range(101)])], "level double, points array<struct<x:double,y:double>>")
    assert [len(r.points) for r in contours.simplify(line, 0.01).collect()] == [2]
    got = contours.label_positions(line, 30.0, 10.0, 4.0).orderBy("x").collect()
    assert [(r.x, r.y, r.angle) for r in got] == [(15, 0, 0), (45, 0, 0), (75, 0, 0)]
    assert contours.label_positions(line, 30.0, 200.0).count() == 0
    up = contours.places_along(np.array([0.0, 0.0]), np.array([10.0, 0.0]), 100.0, 1.0, 2.0)
    assert up == [(0.0, 5.0, 90.0)]  # falling lines read from below


def test_contour_features_go_to_the_writers(spark):
    from bathyal.operators import contours
    from bathyal.sinks import writers

    c = np.arange(12)
    col, row = (a.ravel() for a in np.meshgrid(c, c))
    cone = frame(spark, row=row, col=col, z=6 - np.hypot(col - 5.5, row - 5.5))
    lines = contours.make_contours(cone, 1.0, 1.0, index_every=2, min_length=3.0)
    facts = contours.set_facts(lines).first()
    assert facts.levels >= 4 and facts.x1 >= 0 and facts.x2 <= 12
    text = [r.value for r in writers.geojson_features(contours.contour_features(lines)).collect()]
    assert len(text) == facts.lines and all('"TYPE":"' in t for t in text)


def test_degenerate_layout(spark):
    from bathyal.operators import cameras

    flat = frame(spark, x=[0.0, 1.0, 0.0, 1.0], y=[0.0, 0.0, 1.0, 1.0], z=[0.0, 0.0, 0.0, 0.1])
    assert not cameras.degenerate(flat)
    assert cameras.degenerate(frame(spark, x=[0.0, 1.0, 2.0], y=[0.0, 1.0, 2.001], z=[0.0, 0.0, 0.0]))
    assert cameras.degenerate(flat.limit(2))
