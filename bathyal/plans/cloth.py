"""The query over the cloth simulation and its SQL oracle, which steps all cells at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from bathyal.operators import ground
from bathyal.plans.registry import query
from bathyal.sources import views

CELL = 24
CLOTH = f"""l AS MATERIALIZED (SELECT floor(y / {CELL})::BIGINT AS row, floor(x / {CELL})::BIGINT AS col, max(-z) AS h FROM pts GROUP BY ALL),
g AS MATERIALIZED (SELECT r.row, c.col, coalesce(h, '-infinity'::DOUBLE) AS h FROM (SELECT unnest(range((SELECT min(row) FROM l), (SELECT max(row) + 1 FROM l))) AS row) r,
  (SELECT unnest(range((SELECT min(col) FROM l), (SELECT max(col) + 1 FROM l))) AS col) c LEFT JOIN l ON l.row = r.row AND l.col = c.col),
s AS (SELECT 0 AS it, row, col, h, (SELECT max(h) + 1 FROM l) AS c, true AS free FROM g
  UNION ALL
  SELECT it + 1, row, col, h, CASE WHEN still THEN greatest(fallen + .5 * ((
      coalesce(lag(fallen) OVER across, fallen) + coalesce(lead(fallen) OVER across, fallen) + coalesce(lag(fallen) OVER down, fallen) + coalesce(lead(fallen) OVER down, fallen)) / 4 - fallen), h) ELSE fallen END, still
  FROM (SELECT *, CASE WHEN free AND c - .390625 <= h THEN h WHEN free THEN c - .390625 ELSE c END AS fallen, free AND c - .390625 > h AS still FROM s WHERE it < 400)
  WINDOW across AS (PARTITION BY row ORDER BY col), down AS (PARTITION BY col ORDER BY row)),
e AS (SELECT row, col, -c AS z FROM s WHERE it = 400),
b AS (SELECT point_id, z, floor(y / {CELL} - .5)::BIGINT AS r0, floor(x / {CELL} - .5)::BIGINT AS c0, y / {CELL} - .5 - floor(y / {CELL} - .5) AS fy, x / {CELL} - .5 - floor(x / {CELL} - .5) AS fx FROM pts),
k AS (SELECT point_id, b.z, (CASE dr WHEN 0 THEN 1 - fy ELSE fy END) * (CASE dc WHEN 0 THEN 1 - fx ELSE fx END) AS w, e.z AS ez FROM b, range(0, 2) t(dr), range(0, 2) u(dc), e WHERE e.row = r0 + dr AND e.col = c0 + dc)
SELECT point_id, abs(any_value(z) - sum(w * ez) / sum(w)) <= 2.5 AS ground, round(any_value(z) - sum(w * ez) / sum(w), 5) AS height FROM k GROUP BY point_id"""


@query("pts", CLOTH)
def ground_csf(spark, sf_dir):
    found = ground.csf(views.pts(spark, sf_dir), cloth=float(CELL), rigidness=1, iterations=400, threshold=2.5, time_step=0.625)
    return found.select("point_id", "ground", F.round("height", 5).alias("height"))
