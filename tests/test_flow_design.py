from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bathyal.operators import design, flow


def surface(spark, z):
    row, col = (a.ravel() for a in np.indices(z.shape))
    flat = z.ravel()
    keep = ~np.isnan(flat)
    return spark.createDataFrame(pd.DataFrame({"row": row[keep], "col": col[keep], "z": flat[keep]}))


def test_sinks_flow_and_water(spark):
    z = np.add.outer(np.arange(7) * 0.0, np.arange(7) * 1.0) + 5
    z[3, 3] = 1.0
    filled = flow.fill_sinks(surface(spark, z))
    got = {(r.row, r.col): r.filled for r in filled.collect()}
    assert got[3, 3] == pytest.approx(7.00001, abs=1e-4) and got[2, 2] == pytest.approx(z[2, 2], abs=1e-3)
    acc = {(r.row, r.col): r.cells for r in flow.accumulation(flow.directions(filled)).collect()}
    assert sum(v for (r, c), v in acc.items() if c == 0) == 49
    water = flow.inundation(surface(spark, z), 7.5, (0, 0)).collect()
    assert {(r.row, r.col) for r in water} == {(r, c) for r in range(7) for c in range(7) if z[r, c] < 7.5}


def test_holes(spark):
    z = np.ones((8, 9))
    z[3:5, 4] = np.nan
    z[0, 5] = np.nan
    z[6, 0:2] = np.nan
    found = {(r.row, r.col): r.n for r in flow.holes(surface(spark, z)).collect()}
    assert found == {(3, 4): 2, (4, 4): 2}
    assert flow.fill_holes(surface(spark, z), 5).count() == 8 * 9 - 3
    assert flow.fill_holes(surface(spark, z), 1).count() == 8 * 9 - 5


def test_trench_and_berm(spark):
    z = np.full((80, 400), -10.0)
    line = [(0.0, 10.0), (100.0, 10.0)]
    near = design.route_offsets(surface(spark, z), 0.25, line, 9.0)
    profile = design.seabed_profile(near, 1.0, 2.0, 10.0)
    dug = design.trench(near, profile, 1.0, 0.25, 1.0, 2.0, 2.0, 25.0).collect()
    assert sum(r.volume for r in dug) == pytest.approx(100 * (1 * 2 + 2 * 2 * 2), rel=0.01)
    body = design.berm(near, profile, 1.0, 2.0, 1.0, 3.0)
    low = body.withColumn("z", F.when(F.col("ch") < 50, F.col("z") - 0.4).otherwise(F.col("z")))
    bins = {r.bin: r for r in design.berm_check(body, low, 0.25, 50.0).collect()}
    assert bins[0].under == pytest.approx(0.4 * bins[0].under_area) and bins[1].under == 0 and bins[0].surveyed == 1


def test_dredging_with_slopes(spark):
    z = np.full((120, 160), -10.0)
    ring = [(10.0, 10.0), (30.0, 10.0), (30.0, 20.0), (10.0, 20.0)]
    got = design.side_slopes(surface(spark, z), 0.25, ring, -12.0, 3.0, 3.0)
    cut = got.agg((F.sum(F.col("z") - F.col("design")) * 0.0625).alias("v")).first().v
    assert cut == pytest.approx(20 * 10 * 2 + 60 * 3 * 2 * 2 / 2 + math.pi * (3 * 2) ** 2 * 2 / 3, rel=0.01)


def test_migration_of_waves(spark):
    s = np.arange(600)
    wave = lambda shift: spark.createDataFrame(pd.DataFrame({"station": s, "v": np.sin((s - shift) / 30 * 2 * np.pi) + 0.3 * np.sin((s - shift) / 17)}))
    got = design.migration(wave(0), wave(7.4), 1.0, 200, 12, 2.0).collect()
    assert len(got) == 3 and all(r.reliable and r.shift == pytest.approx(7.4, abs=0.3) and r.rate == pytest.approx(3.7, abs=0.15) for r in got)
    az = spark.createDataFrame([(350.0,), (10.0,), (5.0,)], "a double").agg(design.circular_median(F.col("a"))).first()[0]
    assert az == pytest.approx(5, abs=1)


def test_accumulation_of_a_long_path_and_a_tree(spark):
    """A thousand cells in a row in a few rounds; a random tree as by brute force."""
    import random
    import time

    rows = [(0, c, 0, c + 1) if c < 999 else (0, c, None, None) for c in range(1000)]
    frame = spark.createDataFrame(rows, "row long, col long, to_row long, to_col long")
    began = time.time()
    got = {r.col: r.cells for r in flow.accumulation(frame).collect()}
    assert got == {c: c + 1 for c in range(1000)} and time.time() - began < 60
    rng = random.Random(3)
    down = {i: rng.randrange(max(0, i - 9), i) if i and i % 17 else None for i in range(300)}
    want = dict.fromkeys(down, 0)
    for i in down:
        at = i
        while at is not None:
            want[at] += 1
            at = down[at]
    rows = [(i // 20 - 5, i % 20, None if d is None else d // 20 - 5, None if d is None else d % 20) for i, d in down.items()]
    got = {(r.row + 5) * 20 + r.col: r.cells for r in flow.accumulation(spark.createDataFrame(rows, "row long, col long, to_row long, to_col long").repartition(3)).collect()}
    assert got == want
