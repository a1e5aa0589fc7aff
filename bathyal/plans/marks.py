"""Queries over lane lines and poles, with SQL oracles that know the lines and poles the tables were bent to."""

from __future__ import annotations

from pyspark.sql import functions as F

from bathyal.operators import marks
from bathyal.plans.registry import query
from bathyal.sources import views


@query("pts", """l AS (SELECT point_id // 50 AS lane, count(*) AS points FROM pts GROUP BY ALL)
SELECT lane::BIGINT AS lane, CASE WHEN lane % 2 = 0 THEN 5 ELSE 2 END::BIGINT AS stripes, CASE WHEN lane % 2 = 0 THEN 'dashed' ELSE 'solid' END AS kind,
  CASE WHEN lane % 2 = 0 THEN 39.0 ELSE 15.0 END::DOUBLE AS length, points FROM l WHERE points = 50""")
def lane_lines(spark, sf_dir):
    """All points as paint on lanes 20 m apart, fifty each: five dashes 9 m apart, or a line whose parts nearly touch."""
    i = F.col("point_id") % 50
    lane, dash, step = F.floor(F.col("point_id") / 50), F.floor(i / 10), i % 10
    x = dash * F.when(lane % 2 == 0, 9.0).otherwise(3.1) + step * 0.3
    paint = views.pts(spark, sf_dir).select("point_id", x.alias("x"), (lane * 20.0 + 0.04 * (2 * (step % 2) - 1)).alias("y"), F.lit(0.0).alias("z"))
    facts, vertices, _ = marks.extract_markings(paint)
    on = paint.groupBy(F.floor(F.col("point_id") / 50).alias("lane")).agg(F.count(F.lit(1)).alias("points"))
    rows = facts.select(F.floor(F.col("line") / 50).alias("lane"), "stripes", "kind", F.round("length", 0).alias("length"))
    return rows.join(on, "lane").where("points = 50")


@query("pts", """p AS (SELECT point_id // 50 AS pole, (point_id // 2) % 25 AS i FROM pts WHERE point_id % 2 = 1),
h AS (SELECT pole, i, 0.41 + i * 0.2::DOUBLE AS h, 10.0 * (pole % 100) + 5 + 0.05 * (i % 5 - 2) AS x FROM p),
f AS (SELECT pole, count(*) AS points, avg(x) AS x, max(h) AS height, count(DISTINCT floor(h / 0.25)) AS steps FROM h GROUP BY pole)
SELECT pole::BIGINT AS pole, points, round(x, 5)::DOUBLE AS x, (10.0 * (pole // 100) + 5)::DOUBLE AS y, round(pole * 0.01, 5)::DOUBLE AS z_ground, round(height, 5)::DOUBLE AS height
FROM f WHERE points >= 10 AND height >= 2.5 AND steps >= 0.6 * ceil(height / 0.25)""")
def pole_columns(spark, sf_dir):
    """All points as poles 10 m apart and the ground around them, half of them each."""
    pole, i = F.floor(F.col("point_id") / 50), F.floor(F.col("point_id") / 2) % 25
    up = F.col("point_id") % 2 == 1
    x = 10.0 * (pole % 100) + 5 + F.when(up, 0.05 * (i % 5 - 2)).otherwise((i / 25 - 0.5) * 2)
    z = pole * 0.01 + F.when(up, 0.41 + i * 0.2).otherwise(0.0)
    points = views.pts(spark, sf_dir).select("point_id", x.alias("x"), (10.0 * F.floor(pole / 100) + 5).alias("y"), z.alias("z"))
    poles, _ = marks.extract_poles(points, points.where("point_id % 2 = 0"))
    return poles.select(F.floor(F.col("pole") / 50).alias("pole"), "points", *[F.round(c, 5).alias(c) for c in ("x", "y", "z_ground", "height")])
