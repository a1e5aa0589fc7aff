"""Markings and poles of a synthetic road, whose lines and poles are known."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from bathyal.operators import marks


def _strip(rng, x0, y0, length, width, angle=0.0, per=60):
    n = int(length * per * max(width, 0.1) * 10)
    t, s = rng.uniform(0, length, n), rng.uniform(-width / 2, width / 2, n)
    return np.column_stack([x0 + t * np.cos(angle) - s * np.sin(angle), y0 + t * np.sin(angle) + s * np.cos(angle), np.zeros(n)])


def _frame(spark, parts, first=0):
    p = np.vstack(parts)
    return spark.createDataFrame(pd.DataFrame({"point_id": np.arange(first, first + len(p)), **dict(zip("xyz", p.T))}))


@pytest.fixture(scope="module")
def road(spark):
    """A solid line, a dashed one (3 m every 9 m), a dashed curve, a stop line, a crossing of five bars, and an arrow-like blob."""
    rng = np.random.default_rng(3)
    parts = [_strip(rng, 0, 0, 40, 0.12)]
    parts += [_strip(rng, 9 * k, 3.5, 3, 0.12) for k in range(5)]
    for k in range(4):  # on a circle of 100 m
        g = np.linspace(0.09 * k, 0.09 * k + 0.03, 250)
        s = rng.uniform(-0.06, 0.06, 250)
        parts.append(np.column_stack([(100 + s) * np.sin(g), 120 - (100 + s) * np.cos(g), 0 * g]))
    parts.append(_strip(rng, 42, -3, 6, 0.35, np.pi / 2, per=30))
    parts += [_strip(rng, 46, -3 + 1.1 * k, 3, 0.4, per=30) for k in range(5)]
    parts.append(rng.uniform(0, 1, (200, 3)) * [1, 1, 0] + [60, 10, 0])
    return _frame(spark, parts)


def test_markings_and_partitions(spark, road):
    facts, vertices, members = marks.extract_markings(road)
    facts, vertices, members = facts.toPandas(), vertices.toPandas(), members.toPandas()
    assert sorted(facts.kind) == ["dashed", "dashed", "solid", "stop"]
    length = facts.set_index("kind").length
    assert abs(length["solid"] - 40) < 0.3 and abs(length["stop"] - 6) < 0.3
    assert sorted(length["dashed"].round()) == [30, 39]  # 0.3 rad on 100 m; four steps and a dash
    assert sorted(facts[facts.kind == "dashed"].stripes) == [4, 5]
    for _, v in vertices.groupby("line"):
        v = v.sort_values("seq")
        d = np.diff(v[["x", "y"]].to_numpy(), axis=0)
        assert (v.seq.to_numpy() == np.arange(len(v))).all()
        assert (np.hypot(*d.T) < 12).all() and (d @ d.sum(0) > -0.1).all()  # in order, without ways back
    assert len(members) == road.count() and set(members.kind) == {"line", "stop", "other"}
    assert (members[members.point_id >= road.count() - 200].kind == "other").all()
    again, _, _ = marks.extract_markings(road.repartition(7))
    plain = lambda rows: sorted((r.line, r.stripes, round(r.length, 6), r.kind) for r in rows)
    assert plain(again.collect()) == plain(facts.itertuples())


def test_no_paint(spark):
    df = spark.createDataFrame([(1, 0.0, None, 1.0)], "point_id long, x double, y double, z double")
    assert [f.count() for f in marks.extract_markings(df)] == [0, 0, 0]


def test_cells_at_corners_and_bridges(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1), (0, 3), (5, 0)], "row long, col long")
    apart = {(r.row, r.col): r.region for r in marks.linked_cells(cells).collect()}
    assert apart[0, 0] == apart[1, 1] != apart[0, 3] and len(set(apart.values())) == 3
    bridged = {(r.row, r.col): r.region for r in marks.linked_cells(cells, 1).collect()}
    assert bridged[0, 0] == bridged[0, 3] and bridged[5, 0] != bridged[0, 0]


def test_flat_points_leave_out_walls(spark):
    rng = np.random.default_rng(4)
    bed = np.column_stack([rng.uniform(0, 4, 3000), rng.uniform(0, 4, 3000), rng.normal(0, 0.01, 3000)])
    wall = np.column_stack([rng.uniform(4.3, 4.45, 400), rng.uniform(0, 4, 400), rng.uniform(0, 2, 400)])
    roof = np.column_stack([rng.uniform(1, 2, 50), rng.uniform(1, 2, 50), np.full(50, 3.0)])
    kept = {r.point_id for r in marks.flat_points(_frame(spark, [bed, wall, roof])).collect()}
    assert len([i for i in kept if i < 3000]) > 2900 and not [i for i in kept if i >= 3000]


def test_specks(spark):
    rng = np.random.default_rng(8)
    df = _frame(spark, [_strip(rng, 0, 0, 5, 0.1), np.array([[30.0, 30, 0], [31, 30, 0]])])
    assert marks.without_specks(df, 0.2).agg({"x": "max"}).first()[0] < 6


def test_poles(spark):
    rng = np.random.default_rng(9)
    bed = np.column_stack([rng.uniform(0, 20, 4000), rng.uniform(0, 20, 4000), rng.normal(1, 0.005, 4000)])
    pole = np.column_stack([5 + rng.uniform(-0.1, 0.1, 200), 5 + rng.uniform(-0.1, 0.1, 200), 1 + rng.uniform(0, 6, 200)])
    post = np.column_stack([9 + rng.uniform(-0.1, 0.1, 80), np.full(80, 9.0), 1 + rng.uniform(0, 1.5, 80)])  # too low
    crown = np.column_stack([14 + rng.uniform(-2, 2, 500), 14 + rng.uniform(-2, 2, 500), 1 + rng.uniform(2, 6, 500)])  # too wide
    sign = np.column_stack([np.full(40, 17.0), np.full(40, 3.0), 1 + rng.uniform(4.5, 5, 40)])  # hangs in the air
    points = _frame(spark, [bed, pole, post, crown, sign])
    poles, members = marks.extract_poles(points, points.where("point_id < 4000"))
    rows = poles.collect()
    assert len(rows) == 1
    assert abs(rows[0].x - 5) < 0.02 and abs(rows[0].y - 5) < 0.02 and abs(rows[0].height - 6) < 0.15 and abs(rows[0].z_ground - 1) < 0.05
    assert {4000 <= r.point_id < 4200 for r in members.collect()} == {True}


@pytest.mark.parametrize("bridge", [0, 1, 2])
def test_linked_cells_across_tiles(spark, bridge):
    """As by all pairs of cells, whatever the tiles; blocks meet at sides and corners, within tiles and across their borders."""
    rng = np.random.default_rng(bridge)
    size = 25 * (2 * bridge + 1)
    held = pd.DataFrame(np.unique(rng.integers(-size, size, (500 if bridge else 900, 2)), axis=0), columns=["row", "col"])
    p = held.to_numpy()
    near = np.abs(p[:, None] - p).max(2) <= 2 * bridge + 1
    label = np.arange(len(p))
    while True:
        least = np.where(near, label, len(p)).min(1)
        if (least == label).all():
            break
        label = least
    assert 20 < len(set(label)) < len(p) - 50
    for tile in (2 * bridge + 1, 4 * (2 * bridge + 1), None):
        got = marks.linked_cells(spark.createDataFrame(held), bridge, tile).toPandas().merge(held.assign(label=label), on=["row", "col"])
        assert len(got) == len(held)
        assert (got.groupby("region").label.nunique() == 1).all() and (got.groupby("label").region.nunique() == 1).all()


def test_cells_are_not_multiplied_to_be_linked(spark):
    """A tile is given its own cells and those next to it, not the cells that they grow to."""
    cells = pd.DataFrame({"row": np.arange(0, 900, 3), "col": 500})
    pieces = marks._tile_links(cells.assign(own=True), 5)
    assert len(pieces) == len(cells) and pieces.region.nunique() == 1
    found = marks.linked_cells(spark.createDataFrame(cells), 2)
    assert (found.count(), found.select("region").distinct().count()) == (300, 1)
