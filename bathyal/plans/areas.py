"""The query over depth areas and its SQL oracle, which floods runs of cells until none changes and counts holes by Euler's formula."""

from __future__ import annotations

from pyspark.sql import functions as F

from bathyal.operators import areas
from bathyal.plans.registry import query
from bathyal.sources import views

LEVELS = (50, 120, 140, 160, 500)

DEPTH_AREAS = f"""z AS (SELECT row, col, -max(n.z) AS depth FROM seabed s JOIN (SELECT row + dr AS row, col + dc AS col, z FROM seabed, range(-1, 2) t(dr), range(-1, 2) u(dc)) n USING (row, col) GROUP BY ALL),
m AS (SELECT min(depth) AS low, max(depth) AS high FROM z),
l AS (SELECT unnest([{', '.join(f'{d}.0::DOUBLE' for d in LEVELS)}]) AS d),
k AS (SELECT list_concat([low], list_concat((SELECT coalesce(list(d ORDER BY d), []) FROM l, m WHERE d > low AND d < high), [high])) AS e FROM m),
c AS MATERIALIZED (SELECT row, col, len(list_filter(e[2:len(e) - 1], lambda d: depth >= d)) AS class FROM z, k),
i AS MATERIALIZED (SELECT row, col, class, sum(across) OVER (ORDER BY row, col ROWS UNBOUNDED PRECEDING) AS h, sum(down) OVER (ORDER BY col, row ROWS UNBOUNDED PRECEDING) AS v FROM (
  SELECT *, (lag(col) OVER a IS DISTINCT FROM col - 1 OR lag(class) OVER a IS DISTINCT FROM class)::INT AS across, (lag(row) OVER d IS DISTINCT FROM row - 1 OR lag(class) OVER d IS DISTINCT FROM class)::INT AS down
  FROM c WINDOW a AS (PARTITION BY row ORDER BY col), d AS (PARTITION BY col ORDER BY row))),
f AS (SELECT 0 AS it, row, col, class, h, v, h AS label, true AS moved FROM i
  UNION ALL
  SELECT it + 1, row, col, class, h, v, least, bool_or(least <> label) OVER () FROM (
    SELECT *, min(beside) OVER (PARTITION BY v) AS least FROM (SELECT *, min(label) OVER (PARTITION BY h) AS beside FROM f WHERE moved))),
g AS MATERIALIZED (SELECT row, col, class, label FROM f WHERE NOT moved),
n AS (SELECT g.label, g.class, g.row, g.col, (e.label IS NOT NULL)::INT AS east, (s.label IS NOT NULL)::INT AS north, (e.label IS NOT NULL AND s.label IS NOT NULL AND d.label IS NOT NULL)::INT AS block FROM g
  LEFT JOIN g e ON e.row = g.row AND e.col = g.col + 1 AND e.label = g.label LEFT JOIN g s ON s.row = g.row + 1 AND s.col = g.col AND s.label = g.label LEFT JOIN g d ON d.row = g.row + 1 AND d.col = g.col + 1 AND d.label = g.label)
SELECT round(e[class + 1], 2) AS drval1, round(e[class + 2], 2) AS drval2, count(*) AS cells, (count(*) * 900)::DOUBLE AS area, ((4 * count(*) - 2 * sum(east + north)) * 30)::DOUBLE AS length, (1 - (count(*) - sum(east + north) + sum(block)))::BIGINT AS holes
FROM n, k GROUP BY label, class, e"""


@query("seabed", DEPTH_AREAS)
def depth_areas(spark, sf_dir):
    facts, _ = areas.depth_areas(views.seabed(spark, sf_dir), 30.0, LEVELS)
    return facts.drop("region")


@query("seabed", """c AS (SELECT floor(x / 30)::BIGINT AS col, floor(y / 50)::BIGINT AS row, count(*) AS n FROM soundings GROUP BY ALL), m AS (SELECT col, row FROM c WHERE n >= 3)
SELECT (SELECT count(*) FROM m) AS cells, (SELECT count(*) FROM m)::DOUBLE AS area, (4 * (SELECT count(*) FROM m) - 2 * ((SELECT count(*) FROM m a JOIN m b ON b.row = a.row AND b.col = a.col + 1) + (SELECT count(*) FROM m a JOIN m b ON b.col = a.col AND b.row = a.row + 1)))::DOUBLE AS length""")
def ring_lengths(spark, sf_dir):
    """The areas and lengths of all rings around well covered cells add up to those of the cells."""
    mask = views.soundings(spark, sf_dir).groupBy(F.floor(F.col("y") / 50).alias("row"), F.floor(F.col("x") / 30).alias("col")).count().where("count >= 3")
    facts, _ = areas.rings(areas.regions(mask.select("row", "col", F.lit(1).alias("class"))))
    total = facts.agg(F.sum("area").alias("area"), F.sum("length").alias("length"))
    return mask.agg(F.count(F.lit(1)).alias("cells")).crossJoin(total)  # each is one row
