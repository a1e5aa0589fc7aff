"""Queries over planes and similarities among outliers, with SQL oracles that know the truth the tables were bent to."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from bathyal.operators import robust
from bathyal.plans.registry import query
from bathyal.sources import views

#: Three planes over parts of the points, far apart at their common borders: x from, slopes along x and y, height.
ROOFS = [(-1.0, 0.1, 0.0, 5.0), (240.0, -0.05, 0.2, 100.0), (480.0, 0.0, 0.0, 300.0)]
_Z = "CASE WHEN x >= 480 THEN 300.0 WHEN x >= 240 THEN 100.0 - 0.05 * x + 0.2 * y ELSE 5.0 + 0.1 * x END"


LIMIT, SPACING, LEAST = 0.05, 60.0, 20


def _normal(k: int) -> np.ndarray:
    _, a, b, _ = ROOFS[k]
    return np.array([-a, -b, 1.0]) / math.sqrt(a * a + b * b + 1)


def _place(k: int, axis: int) -> str:
    """A point's cell on a plane along one of its two axes, from the cloud's middle."""
    v = robust.cell_basis(_normal(k))[axis]
    return f"floor(((p.x - mx) * {float(v[0])!r}::DOUBLE + (p.y - my) * {float(v[1])!r}::DOUBLE + (p.z - mz) * {float(v[2])!r}::DOUBLE) / {SPACING})::BIGINT"


def _turn(t: int) -> str:
    """One plane: the one with most points left, and its patches of cells that hang together and hold enough points,
    with heights fitted over x and y; so near a plane that is the fit by distance."""
    off = " ".join(f"WHEN {k} THEN abs(p.z - ({a} * p.x + {b} * p.y + {c})) * {float(_normal(k)[2])!r}::DOUBLE" for k, (_, a, b, c) in enumerate(ROOFS))
    across, down = (f"CASE k {' '.join(f'WHEN {k} THEN {_place(k, axis)}' for k in range(3))} END" for axis in (0, 1))
    return f"""o{t} AS MATERIALIZED (SELECT point_id, x, y, z, k, {across} AS col, {down} AS row FROM p{t} p, middle, range(3) u(k) WHERE CASE k {off} END < {LIMIT}),
b{t} AS (SELECT k FROM o{t} GROUP BY k ORDER BY count(*) DESC, k LIMIT 1), m{t} AS MATERIALIZED (SELECT * FROM o{t} WHERE k = (SELECT k FROM b{t})),
i{t} AS MATERIALIZED (SELECT row, col, sum(a) OVER (ORDER BY row, col ROWS UNBOUNDED PRECEDING) AS h, sum(d) OVER (ORDER BY col, row ROWS UNBOUNDED PRECEDING) AS v FROM (
  SELECT row, col, (lag(col) OVER (PARTITION BY row ORDER BY col) IS DISTINCT FROM col - 1)::INT AS a, (lag(row) OVER (PARTITION BY col ORDER BY row) IS DISTINCT FROM row - 1)::INT AS d FROM (SELECT DISTINCT row, col FROM m{t}))),
f{t} AS (SELECT row, col, h, v, h AS label, true AS moved FROM i{t}
  UNION ALL SELECT row, col, h, v, least, bool_or(least <> label) OVER () FROM (SELECT *, min(beside) OVER (PARTITION BY v) AS least FROM (SELECT *, min(label) OVER (PARTITION BY h) AS beside FROM f{t} WHERE moved))),
s{t} AS MATERIALIZED (SELECT m.*, label, count(*) OVER (PARTITION BY label) AS points FROM m{t} m JOIN (SELECT row, col, label FROM f{t} WHERE NOT moved) USING (row, col)),
c{t} AS (SELECT points, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, min(z) AS z_min, max(z) AS z_max
  FROM s{t} WHERE points >= {LEAST} GROUP BY label, points),
g{t} AS (SELECT *, mz - a * mx - b * my AS c, sqrt(a * a + b * b + 1) AS size FROM (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM c{t})),
p{t + 1} AS MATERIALIZED (SELECT * FROM p{t} WHERE point_id NOT IN (SELECT point_id FROM s{t} WHERE points >= {LEAST}))"""


@query("pts", f"""p0 AS MATERIALIZED (SELECT point_id, x, y, ({_Z})::DOUBLE AS z FROM pts),
middle AS (SELECT round((min(x) + max(x)) / 2) AS mx, round((min(y) + max(y)) / 2) AS my, round((min(z) + max(z)) / 2) AS mz FROM p0),
{', '.join(map(_turn, range(3)))}
SELECT points, round(angle, 4) AS dip, CASE WHEN angle > 0.5 THEN round((degrees(atan2(-a, -b)) + 360) % 360, 3) ELSE 0 END::DOUBLE AS dip_dir, round(-c / size, 3) AS d, round(z_min, 4) AS z_min, round(z_max, 4) AS z_max
FROM (SELECT *, degrees(acos(1 / size)) AS angle FROM ({' UNION ALL '.join(f'SELECT * FROM g{t}' for t in range(3))}))""")
def plane_segments(spark, sf_dir):
    """All points on three sloping planes: each comes back with its points, dip and place. Where planes meet, points near both are
    of the one that has more."""
    p = views.pts(spark, sf_dir).withColumn("z", F.expr(_Z).cast("double"))
    facts, _ = robust.detect_planes(p, limit=LIMIT, min_points=LEAST, max_planes=6, spacing=SPACING, size=100.0)
    return facts.select("points", F.round("dip", 4).alias("dip"), F.round("dip_dir", 3).alias("dip_dir"), F.round("d", 3).alias("d"), F.round("z_min", 4).alias("z_min"), F.round("z_max", 4).alias("z_max"))


@query("vec3", """SELECT (SELECT count(*) FROM vec3)::BIGINT AS pairs, (SELECT count(*) FROM vec3 WHERE point_id % 10 >= 3)::BIGINT AS agree, 2.5::DOUBLE AS scale, 100.0::DOUBLE AS tx, -50.0::DOUBLE AS ty, 7.0::DOUBLE AS tz""")
def similarity_among_outliers(spark, sf_dir):
    """A known turn, scale and shift of all places, of which three in ten are spoilt."""
    v = views.vec3(spark, sf_dir)
    bad = F.col("point_id") % 10 < 3
    spoilt = lambda c, k: F.when(bad, c + 50 + F.pmod(F.xxhash64("point_id", F.lit(k)), F.lit(1000)) / 10).otherwise(c)
    pairs = v.select(
        F.col("point_id").alias("pair_id"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"),
        spoilt(-2.5 * F.col("y") + 100, 1).alias("tx"), spoilt(2.5 * F.col("x") - 50, 2).alias("ty"), spoilt(2.5 * F.col("z") + 7, 3).alias("tz"),
    )
    fit = robust.robust_similarity(pairs, 0.01)
    values = [round(float(fit["scale"]), 6), *(round(float(t), 5) + 0.0 for t in fit["shift"])]
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.lit(int(fit["agree"])).cast("long").alias("agree"), *[F.lit(v).alias(n) for n, v in zip(("scale", "tx", "ty", "tz"), values, strict=True)])
