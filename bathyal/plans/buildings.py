"""The query over building models and its SQL oracle, which floods cells of footprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from bathyal.operators import buildings
from bathyal.plans.registry import query
from bathyal.sources import views

CELL, REACH = 4, 5

BUILDINGS = f"""b AS MATERIALIZED (SELECT floor(y / {CELL})::BIGINT AS row, floor(x / {CELL})::BIGINT AS col, z FROM pts WHERE classification = 4),
c AS MATERIALIZED (SELECT DISTINCT row, col FROM b),
f AS (SELECT 0 AS it, row, col, row * 100000 + col AS label FROM c
  UNION ALL
  SELECT it + 1, row, col, least(label,
    CASE WHEN lag(col) OVER across = col - 1 THEN lag(label) OVER across ELSE label END, CASE WHEN lead(col) OVER across = col + 1 THEN lead(label) OVER across ELSE label END,
    CASE WHEN lag(row) OVER down = row - 1 THEN lag(label) OVER down ELSE label END, CASE WHEN lead(row) OVER down = row + 1 THEN lead(label) OVER down ELSE label END)
  FROM f WHERE it < 500 WINDOW across AS (PARTITION BY row ORDER BY col), down AS (PARTITION BY col ORDER BY row)),
g AS MATERIALIZED (SELECT row, col, label FROM f WHERE it = 500),
k AS (SELECT label, count(*) AS n, min(row) * {CELL} - {REACH} AS y1, (max(row) + 1) * {CELL} + {REACH} AS y2, min(col) * {CELL} - {REACH} AS x1, (max(col) + 1) * {CELL} + {REACH} AS x2 FROM g GROUP BY label HAVING count(*) * {CELL * CELL} >= 48),
r AS (SELECT label, count(*) AS points, quantile_cont(z, .5) AS roof, quantile_cont(z, .02) AS lowest FROM b JOIN g USING (row, col) GROUP BY label HAVING count(*) >= 3),
l AS (SELECT label, quantile_cont(z, .5) AS level FROM k JOIN pts ON classification = 2 AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 GROUP BY label),
h AS (SELECT points, n * {CELL * CELL} AS footprint, coalesce(level, lowest) AS ground, roof FROM k JOIN r USING (label) LEFT JOIN l USING (label))
SELECT points, footprint::DOUBLE AS footprint, round(ground, 5) AS ground, round(roof, 5) AS roof, round(roof - ground, 5) AS height, round(footprint * (roof - ground), 3) AS volume, round(footprint * (roof - ground), 3) AS body FROM h WHERE roof > ground"""


@query("pts", BUILDINGS)
def building_volumes(spark, sf_dir):
    """Heights and volumes of all footprints; body is the volume of the closed mesh."""
    from bathyal.operators import mesh

    facts, vertices, faces = buildings.building_models(views.pts(spark, sf_dir), float(CELL), 48.0, 0.0, building=4, ground=2, close=False, reach=float(REACH), min_points=3)
    body = mesh.volume(faces, vertices).select(F.col("mesh_id").alias("region"), F.round("volume", 3).alias("body"))
    return facts.join(body, "region").select("points", "footprint", *[F.round(c, 5).alias(c) for c in ("ground", "roof", "height")], F.round("volume", 3).alias("volume"), "body")
