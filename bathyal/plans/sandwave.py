"""The query over two-dimensional matching of bedforms and its SQL oracle, which tries every offset by sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from bathyal.operators import sandwave
from bathyal.plans.registry import query
from bathyal.sources import views

N, REACH = 8, 2
LINE = [(6.3, 9.2), (72.1, 17.7)]
SIZE = N + 2 * REACH

MATCH = f"""g AS (SELECT sqrt(({LINE[1][0]} - {LINE[0][0]}) ** 2 + ({LINE[1][1]} - {LINE[0][1]}) ** 2) AS total),
w AS (SELECT k, {N} / 2 + k * 4 AS ch, {LINE[0][0]} + ({N} / 2 + k * 4) / total * ({LINE[1][0]} - {LINE[0][0]}) AS x, {LINE[0][1]} + ({N} / 2 + k * 4) / total * ({LINE[1][1]} - {LINE[0][1]}) AS y FROM g, range(0, 100) t(k) WHERE {N} / 2 + k * 4 <= total - {N} / 2 + 1e-6),
o AS (SELECT k, round(y - {N} / 2)::BIGINT AS r0, round(x - {N} / 2)::BIGINT AS c0 FROM w),
a AS MATERIALIZED (SELECT k, row - r0 AS r, col - c0 AS c, z FROM o JOIN epoch_cells ON epoch = 0 AND row BETWEEN r0 AND r0 + {N - 1} AND col BETWEEN c0 AND c0 + {N - 1}),
b AS MATERIALIZED (SELECT k, row - r0 AS r, col - c0 AS c, z FROM o JOIN epoch_cells ON epoch = 1 AND row BETWEEN r0 - {REACH} AND r0 + {N + REACH - 1} AND col BETWEEN c0 - {REACH} AND c0 + {N + REACH - 1}),
m AS (SELECT k, count(*)::DOUBLE AS n, sum(c) AS sc, sum(r) AS sr, sum(c * c) AS cc, sum(c * r) AS cr, sum(r * r) AS rr, sum(z) AS sz, sum(c * z) AS cz, sum(r * z) AS rz FROM a GROUP BY k),
d AS (SELECT *, cc * (rr * n - sr * sr) - cr * (cr * n - sr * sc) + sc * (cr * sr - rr * sc) AS det FROM m),
f AS (SELECT k, n, (cz * (rr * n - sr * sr) - cr * (rz * n - sr * sz) + sc * (rz * sr - rr * sz)) / det AS p, (cc * (rz * n - sr * sz) - cz * (cr * n - sr * sc) + sc * (cr * sz - rz * sc)) / det AS q,
  (cc * (rr * sz - rz * sr) - cr * (cr * sz - rz * sc) + cz * (cr * sr - rr * sc)) / det AS s FROM d),
ok AS (SELECT f.* FROM f JOIN (SELECT k, count(*) AS nb FROM b GROUP BY k) USING (k) WHERE least(n / {N * N}, nb / {SIZE * SIZE}) >= .7),
t AS MATERIALIZED (SELECT ok.k, r.r, c.c, coalesce(a.z - (p * c.c + q * r.r + s), 0) AS v, a.z IS NOT NULL AS held FROM ok, range(0, {N}) r(r), range(0, {N}) c(c) LEFT JOIN a ON a.k = ok.k AND a.r = r.r AND a.c = c.c),
u AS MATERIALIZED (SELECT ok.k, r.r, c.c, coalesce(b.z - (p * c.c + q * r.r + s), 0) AS v FROM ok, range({-REACH}, {N + REACH}) r(r), range({-REACH}, {N + REACH}) c(c) LEFT JOIN b ON b.k = ok.k AND b.r = r.r AND b.c = c.c),
tm AS (SELECT k, avg(v) AS mean, sqrt(var_pop(v) * count(*)) AS size FROM t GROUP BY k),
x AS MATERIALIZED (SELECT k, i, j, sum((t.v - mean) * u.v) / (any_value(size) * sqrt(greatest(sum(u.v * u.v) - sum(u.v) ** 2 / {N * N}, 1e-12))) AS rho
  FROM t JOIN tm USING (k), range({-REACH}, {REACH + 1}) i(i), range({-REACH}, {REACH + 1}) j(j) JOIN u ON u.k = t.k AND u.r = t.r + i AND u.c = t.c + j GROUP BY k, i, j),
e AS (SELECT k, max(rho) AS rho, arg_max(i, rho) AS i, arg_max(j, rho) AS j FROM x GROUP BY k),
h AS (SELECT e.k, e.rho, e.i, e.j, max(x.rho) FILTER (x.i = e.i - 1 AND x.j = e.j) AS i1, max(x.rho) FILTER (x.i = e.i + 1 AND x.j = e.j) AS i2, max(x.rho) FILTER (x.i = e.i AND x.j = e.j - 1) AS j1, max(x.rho) FILTER (x.i = e.i AND x.j = e.j + 1) AS j2 FROM e JOIN x USING (k) GROUP BY ALL),
s AS (SELECT k, rho, i + CASE WHEN i1 IS NOT NULL AND i2 IS NOT NULL THEN greatest(-.5, least(.5, .5 * (i1 - i2) / (i1 - 2 * rho + i2))) ELSE 0 END AS dr, j + CASE WHEN j1 IS NOT NULL AND j2 IS NOT NULL THEN greatest(-.5, least(.5, .5 * (j1 - j2) / (j1 - 2 * rho + j2))) ELSE 0 END AS dc FROM h),
n AS (SELECT k, coalesce(lead(v) OVER down, v) - coalesce(lag(v) OVER down, v) AS gr, CASE WHEN r IN (0, {N - 1}) THEN 1 ELSE 2 END AS dr, coalesce(lead(v) OVER across, v) - coalesce(lag(v) OVER across, v) AS gc, CASE WHEN c IN (0, {N - 1}) THEN 1 ELSE 2 END AS dc FROM t
  WINDOW down AS (PARTITION BY k, c ORDER BY r), across AS (PARTITION BY k, r ORDER BY c)),
j AS (SELECT k, sum((gc / dc) ** 2) AS cc, sum((gr / dr) ** 2) AS rr, sum(gc / dc * gr / dr) AS cr FROM n GROUP BY k),
z AS (SELECT k, .5 * atan2(2 * cr, cc - rr) AS ang, sqrt((cc - rr) ** 2 + 4 * cr * cr) / (cc + rr) AS coh FROM j),
y AS (SELECT k, quantile_cont(v, .95) - quantile_cont(v, .05) AS height FROM t WHERE held GROUP BY k),
r AS (SELECT s.k, rho, coh, height, CASE WHEN coh >= .5 THEN (dc * cos(ang) + dr * sin(ang)) * cos(ang) ELSE dc END AS dx, CASE WHEN coh >= .5 THEN (dc * cos(ang) + dr * sin(ang)) * sin(ang) ELSE dr END AS dy FROM s JOIN z USING (k) JOIN y USING (k))
SELECT w.k, round(dx, 5) AS dx, round(dy, 5) AS dy, round(rho, 5) AS r, round(coh, 5) AS coherence, round(height, 5) AS height, round(sqrt(dx * dx + dy * dy) / 2, 5) AS rate,
  coalesce(NOT (sqrt(dx * dx + dy * dy) > {0.95 * REACH}) AND rho >= .3 AND height >= .3, false) AS reliable FROM w LEFT JOIN r USING (k)"""


@query("epoch_cells", MATCH)
def bedform_matches(spark, sf_dir):
    cells = views.epoch_cells(spark, sf_dir)
    line = spark.createDataFrame([(1, k, *p) for k, p in enumerate(LINE)], "line_id int, seq int, x double, y double")
    first, second = (cells.where(F.col("epoch") == e).select("row", "col", "z") for e in (0, 1))
    found = sandwave.migration(first, second, sandwave.line_windows(line, float(N), 4.0), 1.0, float(N), float(REACH), 2.0, min_corr=0.3)
    return found.select("k", *[F.round(c, 5).alias(c) for c in ("dx", "dy", "r", "coherence", "height", "rate")], "reliable")
