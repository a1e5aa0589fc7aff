"""The query over bundle adjustment; its oracle knows the places that the pixels were made from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bathyal.operators import bundle, cameras
from bathyal.plans.registry import query
from bathyal.sources import views

LENS = bundle.Lens(1000.0, 500.0, 500.0)
#: Turn about the vertical and shift of four cameras that look at all places.
VIEWS = [(-0.3, -1.0), (-0.1, -0.4), (0.15, 0.5), (0.3, 1.1)]


@query("vec3", "SELECT point_id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z FROM vec3")
def bundle_places(spark, sf_dir):
    """All places from their pixels in four images, begun a few hundredths beside them and with two poses unknown."""
    v = views.vec3(spark, sf_dir).select("point_id", "x", "y", "z")
    poses = {k: (bundle.rotation(np.array([0.0, a, 0.0])), np.array([s, 0.05 * k, 6.0])) for k, (a, s) in enumerate(VIEWS)}
    seen = None
    for k, (r, t) in poses.items():
        place = cameras.transformed((F.col("x"), F.col("y"), F.col("z")), r.tolist(), t.tolist())
        at_u, at_v, _ = cameras.pixel(place, LENS.f, LENS.cx, LENS.cy)
        own = v.select("point_id", F.lit(k).alias("image"), at_u.alias("u"), at_v.alias("v"))
        seen = own if seen is None else seen.unionByName(own)
    beside = lambda c, k: (F.col(c) + (F.pmod(F.xxhash64("point_id", F.lit(k)), F.lit(1000)) / 1000 - 0.5) * 0.05).alias(c)
    start = {k: (bundle.rotation(np.array([0.01, -0.01, 0.005])) @ r, t + 0.02) if k > 1 else (r, t) for k, (r, t) in poses.items()}
    _, places, _ = bundle.adjust(seen, v.select("point_id", beside("x", 1), beside("y", 2), beside("z", 3)), start, LENS, loss=1e6, rounds=8, fixed=[0, 1])
    return places.select("point_id", *[(F.round(c, 3) + 0.0).alias(c) for c in "xyz"])
