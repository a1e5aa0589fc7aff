"""Cylinders of a synthetic scene, whose radii, axes and points are known."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from bathyal.operators import cylinders, mesh


def _cylinder(rng, base, axis, r, length, n, noise=0.005):
    a = np.array(axis, float) / np.linalg.norm(axis)
    u = np.cross(a, [0, 0, 1.0] if abs(a[2]) < 0.9 else [1.0, 0, 0])
    u /= np.linalg.norm(u)
    w = np.cross(a, u)
    g, t, rr = rng.uniform(0, 2 * np.pi, n), rng.uniform(0, length, n), r + rng.normal(0, noise, n)
    out = np.cos(g)[:, None] * u + np.sin(g)[:, None] * w
    return np.array(base) + t[:, None] * a + rr[:, None] * out, out


@pytest.fixture(scope="module")
def scene():
    """Two piles, one of them leaning, and a sloping pipe over a flat bed: places, normals and what each point is on."""
    rng = np.random.default_rng(5)
    parts = [_cylinder(rng, (1000, 2000, -10), (0, 0, 1), 0.6, 6, 500), _cylinder(rng, (1006, 2004, -10), (0.1, 0, 1), 0.4, 5, 400), _cylinder(rng, (1010, 1995, -9), (1, 0.5, 0.2), 0.5, 8, 600)]
    bed = np.column_stack([rng.uniform(995, 1020, 800), rng.uniform(1990, 2010, 800), rng.normal(-12, 0.01, 800)])
    p = np.vstack([*[q for q, _ in parts], bed])
    n = np.vstack([*[m for _, m in parts], np.tile([0, 0, 1.0], (800, 1))])
    kind = np.repeat([0, 1, 2, 3], [500, 400, 600, 800])
    return pd.DataFrame({"point_id": np.arange(len(p)), **dict(zip("xyz", p.T)), **dict(zip(("nx", "ny", "nz"), n.T)), "kind": kind})


def _found(spark, scene, parts=4, **settings):
    df = spark.createDataFrame(scene).repartition(parts)
    facts, members = cylinders.detect_cylinders(df, limit=0.03, r_min=0.1, r_max=1.5, min_points=200, normals=df.select("point_id", "nx", "ny", "nz"), **settings)
    return facts.toPandas(), members.toPandas()


def test_every_direction(spark, scene):
    facts, members = _found(spark, scene, axis="any")
    assert sorted(facts.radius.round(2)) == [0.4, 0.5, 0.6]
    assert (facts.rms < 0.01).all()
    pipe = facts[facts.radius.round(2) == 0.5].iloc[0]
    assert abs(pipe[["ax", "ay", "az"]].to_numpy(float) @ (np.array([1, 0.5, 0.2]) / np.sqrt(1.29)) - 1) < 1e-4
    assert abs(pipe.length - 8) < 0.1
    whole = members.merge(scene, on="point_id").groupby("cylinder").kind.agg(["nunique", "count"])
    assert (whole["nunique"] == 1).all()  # no point of the bed or of another one
    assert (whole["count"] >= [0.97 * {0.6: 500, 0.4: 400, 0.5: 600}[round(r, 2)] for r in facts.set_index("cylinder").radius[whole.index]]).all()


def test_upright_only_and_partitions(spark, scene):
    facts, members = _found(spark, scene, parts=1)
    again, others = _found(spark, scene, parts=7)
    assert sorted(facts.radius.round(2)) == [0.4, 0.6]  # the pipe isn't upright
    assert sorted(facts.tilt.round(0)) == [0, 6]
    pd.testing.assert_frame_equal(facts.round(6), again.round(6))
    assert set(map(tuple, members.to_numpy())) == set(map(tuple, others.to_numpy()))
    steep, _ = _found(spark, scene, max_tilt=3.0)
    assert list(steep.radius.round(2)) == [0.6]


def test_longest_run(spark):
    rng = np.random.default_rng(6)
    p, n = _cylinder(rng, (0, 0, 0), (0, 0, 1), 0.5, 12, 1200)
    keep = (p[:, 2] < 4) | (p[:, 2] > 7)  # a gap of three metres, more than a diameter
    df = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(keep.sum()), **dict(zip("xyz", p[keep].T)), **dict(zip(("nx", "ny", "nz"), n[keep].T))}))
    facts, _ = cylinders.detect_cylinders(df, r_max=1.0, min_points=150, max_count=1, normals=df.select("point_id", "nx", "ny", "nz"))
    row = facts.first()
    assert 6.9 < row.bz < 7.2 and 11.8 < row.tz < 12.1 and row.points > 0.95 * (p[:, 2] > 7).sum()


def test_missing_coordinates_and_no_points(spark):
    rows = [(1, 0.0, 0.0, None), (2, float("nan"), 0.0, 1.0), (3, 1.0, 1.0, 1.0)]
    for df in (spark.createDataFrame(rows, "point_id long, x double, y double, z double"), spark.createDataFrame([], "point_id long, x double, y double, z double")):
        facts, members = cylinders.detect_cylinders(df)
        assert facts.count() == members.count() == 0
    with pytest.raises(ValueError):
        cylinders.detect_cylinders(df, axis="sideways")


def test_mesh_is_closed(spark):
    fact = (0, 9, 2.0, 5.0, 0.6, 0.0, 0.8, 1.0, 2.0, 3.0, 4.0, 2.0, 7.0, 36.9, 0.0)
    vertices, faces = cylinders.cylinder_meshes(spark.createDataFrame([fact], cylinders.FACTS), 100)
    assert mesh.boundary_edges(faces).count() == 0
    assert abs(mesh.volume(faces, vertices).first().volume - np.pi * 4 * 5) < 0.1


def test_cells_score_their_hypotheses_without_a_row_for_each_pair(spark, scene):
    """As by pairs of points and hypotheses; the join brings lists, so a point stays one row."""
    points = spark.createDataFrame(scene)
    hypotheses = cylinders.cylinder_hypotheses(points, 3.0, "any", 0.1, 1.5, 1)
    h = hypotheses.toPandas()
    best = cylinders._best_of_cells(points, hypotheses, 0.03, 3.0, 20)
    want = {}
    keys = np.floor(scene[list("xyz")].to_numpy() / 3.0).astype(int)
    for r in h.itertuples():
        own = scene[(keys == [r.cx, r.cy, r.cz]).all(1)]
        a, d = np.array([r.ax, r.ay, r.az]), own[list("xyz")].to_numpy() - [r.px, r.py, r.pz]
        off = np.abs(np.linalg.norm(np.cross(d, a), axis=1) - r.r)
        n = ((off < max(0.06, cylinders.SHARES[2] * r.r)) & (np.abs(own[["nx", "ny", "nz"]].to_numpy() @ a) < 0.4)).sum()
        want[r.cx, r.cy, r.cz] = max(n, want.get((r.cx, r.cy, r.cz), 0))
    assert {(b.cx, b.cy, b.cz): b.n for b in best} == {k: n for k, n in want.items() if n >= 20}
    sizes = next(cylinders._first_of_slots(iter([pd.DataFrame({"cx": [1, 1, 1, 2], "cy": 0, "cz": 0, "slot": [3, 3, 4, 3], "hash": [9, 7, 8, 1], "point_id": [1, 2, 3, 4]})])))
    assert sorted(sizes.point_id) == [2, 3, 4]


def test_points_that_hold_their_normals(spark, scene):
    df = spark.createDataFrame(scene.drop(columns="kind"))
    settings = dict(limit=0.03, r_min=0.1, r_max=1.5, min_points=200, axis="any")
    joined, _ = cylinders.detect_cylinders(df, normals=df.select("point_id", "nx", "ny", "nz"), **settings)
    own, members = cylinders.detect_cylinders(df, normals=df, **settings)
    pd.testing.assert_frame_equal(joined.toPandas().round(6), own.toPandas().round(6))
    assert members.columns == ["point_id", "cylinder"] and members.count() == sum(r.points for r in own.collect())
