"""Queries beside their SQL on small tables of special places."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

from bathyal.plans.catalogue import oracle_sql, queries
from oracle_check import rows


def both(spark, folder, name, x, y, z):
    """The query's and the SQL's rows over events at these places."""
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.rint(np.asarray(x) * 3.6e9).astype(np.int64), unit="us")
    n = len(x)
    frame = pd.DataFrame({"event_id": np.arange(n), "ts": ts, "user_id": np.asarray(y, np.int64), "event_type": "view", "value": np.asarray(z, float), "props": '{"k": 1}'})
    frame.to_parquet(folder / "events.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    mine, other = queries()[name](spark, str(folder)).toPandas(), db.sql(oracle_sql()[name]).df()
    return rows(mine[sorted(mine)]), rows(other[sorted(other)])


def test_contour_through_a_corner(spark, tmp_path):
    """A mean that is a level alone among lower ones makes no segment; a higher one has a ring of four."""
    r, c = (g.ravel() for g in np.mgrid[0:8, 0:8])
    z = np.full(64, 10.0)
    z[(r == 2) & (c == 2)] = 13.0
    z[(r == 5) & (c == 5)] = 14.0
    mine, other = both(spark, tmp_path, "contour_set", c * 30 + 15, r * 30 + 15, z)
    assert mine == other and [m[-1] for m in mine] == [4.0]


def test_planes_that_meet(spark, tmp_path):
    """Points near the line where two planes meet are of the plane that has more points."""
    rng = np.random.default_rng(2)
    x, y = rng.uniform(150, 700, 6000), rng.integers(1000, 1160, 6000)
    mine, other = both(spark, tmp_path, "plane_segments", x, y, np.zeros(6000))
    assert mine == other and len(mine) == 3 and mine[2][3] > ((x >= 240) & (x < 480)).sum()
