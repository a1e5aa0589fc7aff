from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from bathyal.operators import bundle
from bathyal.operators.bundle import Lens

LENS = Lens(800.0, 320.0, 240.0, -0.05, 0.01)


def world(seed=0, n=60, m=5):
    """Cameras on a bow that look at a cloud of points; poses, places and exact pixels."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3))
    poses = {}
    for i in range(m):
        poses[i + 10] = (bundle.rotation(np.array([0.02 * i, 0.15 * (i - m / 2), 0.01])), np.array([0.3 * (i - m / 2), 0.05 * i, 8.0]))
    rows = []
    for i, (r, t) in poses.items():
        pixel, _, _ = bundle.observed(x, np.repeat(r[None], n, 0), np.repeat(t[None], n, 0), LENS)
        rows += [(k, i, *map(float, pixel[k])) for k in range(n)]
    return poses, x, rows, rng


def frames(spark, rows, x):
    observations = spark.createDataFrame(rows, "point_id long, image int, u double, v double")
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "point_id long, x double, y double, z double")
    return observations, points


def test_derivatives():
    poses, x, _, _ = world()
    r, t = (np.repeat(v[None], len(x), 0) for v in poses[11])
    pixel, by_pose, by_place = bundle.observed(x, r, t, LENS)
    h = 1e-6
    for k in range(6):
        w = np.zeros(6)
        w[k] = h
        other, _, _ = bundle.observed(x, np.einsum("ij,njk->nik", bundle.rotation(w[:3]), r), t + w[3:], LENS)
        assert np.allclose((other - pixel) / h, by_pose[:, :, k], atol=2e-2)
    for k in range(3):
        w = np.zeros(3)
        w[k] = h
        assert np.allclose((bundle.observed(x + w, r, t, LENS)[0] - pixel) / h, by_place[:, :, k], atol=2e-2)


@pytest.mark.parametrize("loss", [1e9, 2.0])
def test_a_step_equals_that_of_the_dense_system(loss):
    """Eliminating points and putting them back gives the step of all unknowns at once, with tracks dealt to groups."""
    poses, x, rows, rng = world(1, 12, 4)
    m, n, damping = 4, 12, 1e-3
    table = pd.DataFrame(rows, columns=["point_id", "image", "u", "v"])
    table["camera"] = table["image"] - 10
    table = table[(table.point_id + table.camera) % 5 != 0]
    table[["u", "v"]] += rng.normal(0, 2, (len(table), 2))
    start = x + rng.normal(0, 0.05, x.shape)
    table[["x", "y", "z"]] = start[table.point_id]
    turn, shift = (np.stack([poses[i + 10][k] for i in range(m)]) for k in (0, 1))
    s, g = np.zeros((m, 6, m, 6)), np.zeros((m, 6))
    parts = [bundle._tracks(table[table.point_id % 3 == k]) for k in range(3)]
    for part in parts:
        for row in bundle.reduced(part, turn, shift, LENS, loss, damping).itertuples(index=False):
            s[int(row.i), :, int(row.j)] += np.array(row[2:38]).reshape(6, 6)
            g[int(row.i)] += np.array(row[38:44])
    s = s.reshape(6 * m, 6 * m)
    dense, right = np.zeros((6 * m + 3 * n, 6 * m + 3 * n)), np.zeros(6 * m + 3 * n)
    for row in table.itertuples():
        pixel, a, b = bundle.observed(start[[row.point_id]], turn[[row.camera]], shift[[row.camera]], LENS)
        miss = np.array([row.u, row.v]) - pixel[0]
        w = 1.0 if np.linalg.norm(miss) <= loss else loss / np.linalg.norm(miss)
        j = np.zeros((2, len(right)))
        j[:, 6 * row.camera : 6 * row.camera + 6], j[:, 6 * m + 3 * row.point_id : 6 * m + 3 * row.point_id + 3] = a[0], b[0]
        dense += w * j.T @ j
        right += w * j.T @ miss
    d = np.arange(6 * m, len(right))
    dense[d, d] *= 1 + damping
    c = np.arange(6 * m)
    extra = damping * np.abs(s[c, c])
    dense[c, c] += extra
    s[c, c] += extra
    whole, step = np.linalg.solve(dense, right), np.linalg.solve(s, g.ravel())
    assert np.allclose(step, whole[: 6 * m], rtol=1e-5, atol=1e-9)
    for part in parts:
        new = bundle.places_after(part, turn, shift, LENS, loss, damping, step.reshape(m, 6))
        assert np.allclose(new - start[part.ids], whole[6 * m :].reshape(n, 3)[part.ids], rtol=1e-5, atol=1e-8)


def test_poses_and_points_come_back_among_outliers(spark):
    poses, x, rows, rng = world(2, 80, 5)
    spoilt = [(k, i, u + 60 * (-1) ** k, v - 45 * (-1) ** (k // 2)) if (7 * k + i) % 17 == 0 else (k, i, u, v) for k, i, u, v in rows]
    spoilt += [(0, 99, 1.0, 1.0), (500, 10, 1.0, 1.0), (1, 10, None, 3.0)]
    start = {i: (bundle.rotation(rng.normal(0, 0.01, 3)) @ r if i > 11 else r, t + (rng.normal(0, 0.03, 3) if i > 11 else 0)) for i, (r, t) in poses.items()}
    observations, points = frames(spark, spoilt, x + rng.normal(0, 0.03, x.shape))
    got, places, costs = bundle.adjust(observations.repartition(3), points, start, LENS, loss=0.3, rounds=15, fixed=[10, 11])
    assert costs[-1] < costs[0] * 0.6 and all(a >= b for a, b in zip(costs, costs[1:], strict=False))
    for i, (r, t) in poses.items():
        assert np.allclose(got[i][0], r, atol=4e-3) and np.allclose(got[i][1], t, atol=3e-2)
    found = np.array([(p.x, p.y, p.z) for p in places.orderBy("point_id").collect()])
    assert np.median(np.abs(found - x)) < 5e-3


def test_lone_observations_and_no_points(spark):
    poses, x, rows, _ = world(3, 3, 3)
    observations, points = frames(spark, [r for r in rows if r[0] < 2 or r[1] == 10], x + 0.01)
    _, places, _ = bundle.adjust(observations, points, poses, LENS, rounds=2, fixed=[10, 11])
    got = {r.point_id: r for r in places.collect()}
    assert got[2].x == x[2][0] + 0.01 and abs(got[0].x - x[0][0]) < 0.009
    with pytest.raises(ValueError):
        bundle.adjust(observations, points, {i: poses[10] for i in range(bundle.MOST_CAMERAS + 1)}, LENS)
