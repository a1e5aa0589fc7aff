from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from bathyal.operators import cloth, ground


def whole(df: pd.DataFrame, cell: float, rigidness: int, iterations: int, threshold: float = 0.5):
    """Ground and heights by one array over everything."""
    r, c = np.floor(df.y / cell).astype(int), np.floor(df.x / cell).astype(int)
    r0, c0 = r.min(), c.min()
    floor = np.full((r.max() - r0 + 1, c.max() - c0 + 1), -np.inf)
    np.maximum.at(floor, (r - r0, c - c0), -df.z.to_numpy())
    z, _ = cloth.fall(np.full(floor.shape, -df.z.min() + 1.0), np.ones(floor.shape, bool), floor, iterations, 0.65 * 0.65, rigidness)
    fx, fy = df.x / cell - 0.5 - c0, df.y / cell - 0.5 - r0
    x0, y0 = np.clip(np.floor(fx), 0, floor.shape[1] - 1).astype(int), np.clip(np.floor(fy), 0, floor.shape[0] - 1).astype(int)
    x1, y1 = np.minimum(x0 + 1, floor.shape[1] - 1), np.minimum(y0 + 1, floor.shape[0] - 1)
    tx, ty = np.clip(fx - x0, 0, 1), np.clip(fy - y0, 0, 1)
    ref = -((z[y0, x0] * (1 - tx) + z[y0, x1] * tx) * (1 - ty) + (z[y1, x0] * (1 - tx) + z[y1, x1] * tx) * ty)
    return (df.z - ref).to_numpy(), (np.abs(df.z - ref) <= threshold).to_numpy()


def scene() -> tuple[pd.DataFrame, np.ndarray]:
    """Sloping ground with waves, a flat-roofed building and a group of trees."""
    rng = np.random.default_rng(3)
    terrain = lambda x, y: 15 + 0.05 * x + 2 * np.sin(y / 20)
    x, y = rng.uniform(0, 120, 8000), rng.uniform(0, 120, 8000)
    out = ~((x > 40) & (x < 70) & (y > 40) & (y < 60))
    x, y = x[out], y[out]
    bx, by, tx, ty = rng.uniform(40, 70, 500), rng.uniform(40, 60, 500), rng.normal(95, 3, 600), rng.normal(95, 3, 600)
    z = np.concatenate([terrain(x, y), terrain(bx, by) + 8, terrain(tx, ty) + rng.uniform(3, 12, 600)])
    df = pd.DataFrame({"point_id": np.arange(len(z)), "x": np.concatenate([x, bx, tx]), "y": np.concatenate([y, by, ty]), "z": z})
    return df, np.arange(len(z)) < len(x)


@pytest.mark.parametrize("cell, rigidness, block, margin", [(2.0, 3, None, None), (2.0, 3, 24, 20), (3.0, 1, 9, 8)])
def test_blocks_equal_the_whole(spark, cell, rigidness, block, margin):
    df, _ = scene()
    df.loc[:, "x"] -= 55.5  # cells on both sides of zero
    height, flags = whole(df, cell, rigidness, 60)
    got = cloth.csf(spark.createDataFrame(df).repartition(5), cell, rigidness, 60, block=block, margin=margin).toPandas().set_index("point_id").sort_index()
    assert np.allclose(got.height, height, atol=1e-9) and (got.ground == flags).all()


def test_far_apart_data_leaves_blocks_out(spark):
    """Between two patches the cloth falls freely; cells there are never made, and heights differ from the whole by nothing."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.random(200) * 20, 400 + rng.random(200) * 20])
    df = pd.DataFrame({"point_id": np.arange(400), "x": x, "y": rng.random(400) * 20, "z": rng.random(400)})
    height, flags = whole(df, 1.0, 1, 40)
    got = cloth.csf(spark.createDataFrame(df), 1.0, 1, 40, block=32, margin=30).toPandas().set_index("point_id").sort_index()
    assert np.allclose(got.height, height, atol=1e-9) and (got.ground == flags).all()


def test_errors_of_a_scene(spark):
    df, truth = scene()
    got = ground.ground(spark.createDataFrame(df), "csf", cloth=2.0, rigidness=3).toPandas().set_index("point_id").sort_index().ground.to_numpy()
    assert (~got[truth]).mean() < 0.01 and (got != truth).mean() < 0.03


def test_empty_tables_and_heights_that_are_missing(spark):
    shape = "point_id long, x double, y double, z double"
    assert cloth.csf(spark.createDataFrame([], shape)).count() == 0
    rows = [(i, i % 5 + 0.5, i // 5 + 0.5, 1.0) for i in range(25)] + [(25, 2.5, 2.5, None), (26, 2.5, 2.5, float("nan"))]
    got = {r.point_id: r.ground for r in cloth.csf(spark.createDataFrame(rows, shape), iterations=50).collect()}
    assert sum(got.values()) == 25 and not got[25] and not got[26]
    with pytest.raises(ValueError):
        cloth.settled(spark.createDataFrame([], "row long, col long, z double"), 3, block=8, margin=2)
