"""Queries over water, components, designs, bedforms, contours, tracks and noise, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bathyal.functions import crs
from bathyal.operators import design, extraction, flow, grid, hydrography, noise, points, routes
from bathyal.operators.graph import saved
from bathyal.plans.registry import query
from bathyal.plans.survey import CONCAVE, LINE, _crossings, _segments_sql
from bathyal.sources import views


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Heights on cells of 60 m, rounded so that both sides see the same ties.
DEM = "d AS MATERIALIZED (SELECT floor(y / 30)::BIGINT AS row, floor(x / 30)::BIGINT AS col, round(avg(z), 4) AS z FROM pts GROUP BY ALL)"


def _dem(spark, sf_dir: str) -> DataFrame:
    return saved(grid.build_dem(views.pts(spark, sf_dir), 30.0, "mean").withColumn("z", F.round("z", 4)))


RING = """n AS MATERIALIZED (SELECT a.row, a.col, a.z, b.row - a.row AS dr, b.col - a.col AS dc, b.z AS nz, sqrt((b.row - a.row) ** 2 + (b.col - a.col) ** 2) AS run FROM d a JOIN d b
ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND (a.row <> b.row OR a.col <> b.col))"""
DOWN = f"""{DEM}, {RING}, w AS MATERIALIZED (SELECT row, col, arg_max((row + dr, col + dc), ((z - nz) / run, -dr, -dc)) AS q FROM n WHERE z > nz GROUP BY ALL)"""


@query("pts", f"{DOWN} SELECT row, col, q[1] AS to_row, q[2] AS to_col FROM w")
def flow_directions(spark, sf_dir):
    return flow.directions(_dem(spark, sf_dir), "z").where("to_row is not null")


@query("pts", f"{DOWN}, p AS (SELECT row, col, row AS r, col AS c FROM d UNION ALL SELECT p.row, p.col, q[1], q[2] FROM p JOIN w ON w.row = p.r AND w.col = p.c) SELECT r AS row, c AS col, count(*) AS cells FROM p GROUP BY ALL")
def flow_accumulation(spark, sf_dir):
    return flow.accumulation(saved(flow.directions(_dem(spark, sf_dir), "z")))


@query("pts", f"{DOWN}, p AS (SELECT row, col, row AS r, col AS c FROM d UNION ALL SELECT p.row, p.col, q[1], q[2] FROM p JOIN w ON w.row = p.r AND w.col = p.c) SELECT r AS row, c AS col, count(*) AS cells FROM p GROUP BY ALL HAVING count(*) >= 5")
def flow_streams(spark, sf_dir):
    return flow.streams(flow.accumulation(saved(flow.directions(_dem(spark, sf_dir), "z"))), 5)


@query("pts", f"{DEM} SELECT count(*) AS cells, 0 AS unfilled, 0 AS too_high FROM d")
def filled_sinks(spark, sf_dir):
    """The filled surface is the one fixed point: borders keep their height, no cell is lower than its own height or, if that is
    lower, than its lowest neighbour and the rise, and none is higher than needed."""
    d = _dem(spark, sf_dir)
    f = saved(flow.fill_sinks(d))
    ring = flow._ring(f.select("row", "col", F.col("filled").alias("z"))).groupBy("row", "col").agg(F.min("nz").alias("low"), F.count(F.lit(1)).alias("n"))
    both = f.join(ring, ["row", "col"], "left")
    want = F.when(F.coalesce("n", F.lit(0)) < 8, F.col("z")).otherwise(F.greatest("z", F.col("low") + flow.RISE))
    return both.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("filled") < want - 1e-9).cast("int").alias("unfilled"), F.count_if(F.col("filled") > want + 1e-9).cast("int").alias("too_high"))


PARTS = """p AS (SELECT row, col, row AS r, col AS c FROM l UNION SELECT p.row, p.col, l.row, l.col FROM p JOIN l ON l.row BETWEEN p.r - 1 AND p.r + 1 AND l.col BETWEEN p.c - 1 AND p.c + 1),
m AS (SELECT row, col, min((r, c)) AS part, count(*) AS n FROM p GROUP BY ALL)"""


@query("pts", f"{DEM}, l AS MATERIALIZED (SELECT row, col FROM d WHERE z < 45), {PARTS} SELECT count(*) AS parts, max(n) AS largest, sum(n)::BIGINT AS cells FROM (SELECT part, count(*) AS n FROM m GROUP BY part)")
def low_basins(spark, sf_dir):
    part = flow.cell_components(saved(_dem(spark, sf_dir).where("z < 45").select("row", "col")))
    sizes = part.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("parts"), F.max("n").alias("largest"), F.sum("n").alias("cells"))


@query("pts", f"""{DEM}, l AS MATERIALIZED (SELECT row, col FROM d WHERE z < 55), s AS (SELECT min((row, col)) AS s FROM l),
p AS (SELECT s[1] AS row, s[2] AS col FROM s UNION SELECT l.row, l.col FROM p JOIN l ON l.row BETWEEN p.row - 1 AND p.row + 1 AND l.col BETWEEN p.col - 1 AND p.col + 1)
SELECT row, col, round(55 - z, 4) AS water FROM p JOIN d USING (row, col)""")
def inundation(spark, sf_dir):
    d = _dem(spark, sf_dir)
    seed = d.where("z < 55").agg(F.min(F.struct("row", "col")).alias("s")).first()["s"]
    return _rounded(flow.inundation(d, 55.0, (seed.row, seed.col)), 4)


# ---- design along a line and in a polygon -------------------------------------------------------------------------------

NEAR = f"""e AS MATERIALIZED (SELECT floor(y / 4)::BIGINT AS row, floor(x / 4)::BIGINT AS col, round(avg(z), 4) AS z FROM pts GROUP BY ALL),
x AS (SELECT row, col, z, (col + .5) * 4 AS x, (row + .5) * 4 AS y FROM e),
a AS (SELECT row, col, z, seg, cum, x, y, x1, y1, ux, uy, greatest(0, least(len, (x - x1) * ux + (y - y1) * uy)) AS t FROM x, {_segments_sql()}),
h AS (SELECT row, col, z, seg, t + cum AS ch, (x - x1) * uy - (y - y1) * ux AS off, sqrt((x - x1 - t * ux) ** 2 + (y - y1 - t * uy) ** 2) AS d FROM a),
k AS MATERIALIZED (SELECT row, col, any_value(z) AS z, arg_min(ch, (d, seg)) AS ch, arg_min(off, (d, seg)) AS off, min(d) AS dist FROM h GROUP BY row, col HAVING min(d) <= 30),
s AS MATERIALIZED (SELECT floor(ch / 20)::BIGINT AS station, avg(z) AS level FROM k WHERE abs(off) <= 12 GROUP BY ALL)"""


def _near(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = grid.build_dem(views.pts(spark, sf_dir), 4.0, "mean").withColumn("z", F.round("z", 4))
    near = saved(design.route_offsets(e, 4.0, LINE, 30.0))
    return near, saved(design.seabed_profile(near, 20.0, 12.0))


@query("pts", f"{NEAR} SELECT row, col, round(ch, 6) AS ch, round(off, 6) AS off, round(dist, 6) AS dist FROM k")
def route_offsets(spark, sf_dir):
    return _rounded(_near(spark, sf_dir)[0].drop("z"))


@query("pts", f"{NEAR} SELECT station, round(avg(level) OVER (ORDER BY station ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS level FROM s")
def seabed_profile(spark, sf_dir):
    return _rounded(design.seabed_profile(_near(spark, sf_dir)[0], 20.0, 12.0, 40.0))


@query("pts", f"""{NEAR}, c AS (SELECT floor(ch / 100)::BIGINT AS bin, greatest(0, z - (level - 3 + greatest(0, dist - 1) / 2)) AS cut FROM k JOIN s ON s.station = floor(ch / 20)::BIGINT)
SELECT bin, round(sum(cut) * 16, 5) AS volume, round(sum((cut > 1e-9)::INT) * 16, 5)::DOUBLE AS area FROM c GROUP BY bin""")
def trench(spark, sf_dir):
    near, profile = _near(spark, sf_dir)
    return _rounded(design.trench(near, profile, 20.0, 4.0, 2.0, 3.0, 2.0, 100.0), 5)


BERM = f"""{NEAR}, b AS (SELECT row, col, ch, k.z AS bed, level + 2 - greatest(0, abs(off) - 4) / 3 AS z FROM k JOIN s ON s.station = floor(ch / 20)::BIGINT),
m AS (SELECT * FROM b WHERE z > bed + .05)"""


@query("pts", f"{BERM} SELECT row, col, round(z, 6) AS z, round(bed, 6) AS bed FROM m")
def berm_template(spark, sf_dir):
    near, profile = _near(spark, sf_dir)
    return _rounded(design.berm(near, profile, 20.0, 8.0, 2.0, 3.0).select("row", "col", "z", "bed"))


@query("pts", f"""{BERM}, c AS (SELECT m.*, e.z + 1 - m.z AS d FROM m LEFT JOIN (SELECT * FROM e WHERE (row + col) % 3 <> 0) e USING (row, col))
SELECT floor(ch / 100)::BIGINT AS bin, round(sum(CASE WHEN d > .1 THEN d ELSE 0 END) * 16, 5) AS over, round(sum(CASE WHEN d < -.1 THEN -d ELSE 0 END) * 16, 5) AS under,
round(sum((coalesce(d < -.1, false))::INT) * 16, 5)::DOUBLE AS under_area, round(avg((d IS NOT NULL)::INT), 6) AS surveyed FROM c GROUP BY ALL""")
def berm_check(spark, sf_dir):
    near, profile = _near(spark, sf_dir)
    body = design.berm(near, profile, 20.0, 8.0, 2.0, 3.0)
    built = near.where((F.col("row") + F.col("col")) % 3 != 0).withColumn("z", F.col("z") + 1)
    found = design.berm_check(body, built, 4.0, 100.0)
    return found.select("bin", *[F.round(c, 5).alias(c) for c in ("over", "under", "under_area")], F.round("surveyed", 6).alias("surveyed"))


@query("pts", f"""{NEAR}, r AS (SELECT floor(ch / 100)::BIGINT AS bin, z, level, abs(off) AS o, level - .15 AS edge, greatest(0, abs(off) - 5) AS away FROM k JOIN s ON s.station = floor(ch / 20)::BIGINT),
f AS (SELECT bin, CASE WHEN away > 0 THEN CASE WHEN z > edge THEN least(z, edge + away / 2) ELSE greatest(z, edge - away / 3) END ELSE level - o * .03 END - z AS d FROM r)
SELECT bin, round(sum(greatest(-d, 0)) * 16, 5) AS cut, round(sum(greatest(d, 0)) * 16, 5) AS fill FROM f GROUP BY bin""")
def road_formation(spark, sf_dir):
    near, profile = _near(spark, sf_dir)
    return _rounded(design.road_formation(near, profile, 20.0, 5.0, 3.0, 2.0, 3.0, 100.0, 4.0), 5)


def _ring_distance() -> str:
    ring = [*CONCAVE, CONCAVE[0]]
    parts = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        n = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        ux, uy = (x2 - x1) / n, (y2 - y1) / n
        t = f"greatest(0, least({n!r}::DOUBLE, (x - {x1}) * {ux!r}::DOUBLE + (y - {y1}) * {uy!r}::DOUBLE))"
        parts.append(f"sqrt((x - {x1} - {t} * {ux!r}::DOUBLE) ** 2 + (y - {y1} - {t} * {uy!r}::DOUBLE) ** 2)")
    return f"least({', '.join(parts)})"


@query("pts", f"""{DEM}, x AS (SELECT *, (col + .5) * 30 AS x, (row + .5) * 30 AS y FROM d), a AS (SELECT *, CASE WHEN {_crossings(CONCAVE)} THEN 0 ELSE {_ring_distance()} END AS away FROM x)
SELECT row, col, z, round(CASE WHEN z > 40 THEN least(z, 40 + away / 4) ELSE greatest(z, 40 - away / 2) END, 5) AS design FROM a""")
def side_slopes(spark, sf_dir):
    found = design.side_slopes(_dem(spark, sf_dir), 30.0, CONCAVE, 40.0, 4.0, 2.0)
    return found.select("row", "col", "z", F.round("design", 5).alias("design"))


# ---- bedforms, sections, tracks -----------------------------------------------------------------------------------------

WAVE = """w AS (SELECT floor(x / 4)::BIGINT AS station, round(avg(z), 4) AS v FROM pts GROUP BY 1), q AS (SELECT station + 2 AS s2, v AS vb FROM w),
r AS (SELECT floor(station / 40)::BIGINT AS win, lag, corr(v, vb) AS r FROM w, range(-5, 6) t(lag), q WHERE s2 = station + lag GROUP BY ALL HAVING corr(v, vb) IS NOT NULL AND NOT isnan(corr(v, vb))),
b AS (SELECT *, lag(r) OVER (PARTITION BY win ORDER BY lag) AS rb, lead(r) OVER (PARTITION BY win ORDER BY lag) AS ra FROM r),
m AS (SELECT win, max_by((lag, r, rb, ra), (r, -abs(lag))) AS m FROM b GROUP BY win), f AS (SELECT win, m[1] AS lag, m[2] AS r, m[3] AS rb, m[4] AS ra FROM m),
g AS (SELECT *, coalesce(CASE WHEN rb - 2 * r + ra < 0 THEN (rb - ra) / (2 * (rb - 2 * r + ra)) END, 0) AS sub FROM f)"""


@query("pts", f"{WAVE} SELECT win AS \"window\", round((lag + sub) * 4, 5) AS shift, round((lag + sub) * 4 / 2, 5) AS rate, round(r, 5) AS r, r >= .6 AS reliable FROM g")
def bedform_migration(spark, sf_dir):
    """Stations' means against the same moved by two stations."""
    w = saved(views.pts(spark, sf_dir).groupBy(F.floor(F.col("x") / 4).alias("station")).agg(F.round(F.avg("z"), 4).alias("v")))
    return _rounded(design.migration(w, w.withColumn("station", F.col("station") + 2), 4.0, 40, 5, 2.0), 5)


@query("pts", "m AS (SELECT classification, quantile_cont(sin(radians(x)), .5) AS s, quantile_cont(cos(radians(x)), .5) AS c FROM pts GROUP BY 1) SELECT classification, round((degrees(atan2(s, c)) + 360) % 360, 5) AS azimuth FROM m")
def circular_medians(spark, sf_dir):
    return _rounded(views.pts(spark, sf_dir).groupBy("classification").agg(design.circular_median(F.col("x")).alias("azimuth")), 5)


@query("profile", """s AS (SELECT y AS route_id, k AS station, k * 60.0::DOUBLE AS lo, (k + 1) * 60.0::DOUBLE AS hi FROM (SELECT DISTINCT route_id AS y FROM profile), range(12) t(k)),
p AS (SELECT p.route_id, p.ch, (p.point_id % 11 - 5)::DOUBLE AS off, p.z FROM profile p)
SELECT s.route_id, s.station::INT AS station, round(max(CASE WHEN abs(off) <= 1 THEN z END), 6) AS crest, round((quantile_cont(CASE WHEN off < -1 THEN z END, .5) + quantile_cont(CASE WHEN off > 1 THEN z END, .5)) / 2, 6) AS seabed
FROM p JOIN s ON s.route_id = p.route_id AND ch >= lo AND ch < hi AND abs(off) <= 4 GROUP BY ALL""")
def crest_and_sides(spark, sf_dir):
    p = views.profile(spark, sf_dir).withColumn("off", (F.col("point_id") % 11 - 5).cast("double"))
    s = p.select("route_id").distinct().withColumn("station", F.explode(F.sequence(F.lit(0), F.lit(11))))
    s = s.withColumns({"lo": F.col("station") * 60.0, "hi": (F.col("station") + 1) * 60.0})
    return _rounded(routes.crest_and_sides(p, s, 1.0, 4.0))


@query("profile", "SELECT DISTINCT a.route_id AS a, b.route_id AS b FROM profile a JOIN profile b ON b.route_id BETWEEN a.route_id + 1 AND a.route_id + 3")
def image_pairs(spark, sf_dir):
    return extraction.select_pairs(views.profile(spark, sf_dir).select(F.col("route_id").alias("i")).distinct(), 3)


@query("pts", """p AS (SELECT floor(x / 60)::BIGINT AS vx, floor(y / 60)::BIGINT AS vy, floor(z / 60)::BIGINT AS vz, x, y, z, classification FROM pts)
SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(DISTINCT classification) AS views FROM p GROUP BY vx, vy, vz HAVING count(DISTINCT classification) >= 2""")
def voxel_reduce(spark, sf_dir):
    found = extraction.voxel_reduce(views.pts(spark, sf_dir).withColumnRenamed("classification", "pair"), 60.0, 2)
    return _rounded(found.select("x", "y", "z", "views"))


@query("pts", """s AS (SELECT y::BIGINT AS image, classification AS other, count(*) AS points, avg(z) AS angle FROM pts GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY points DESC, other) AS rank FROM s WHERE angle BETWEEN 20 AND 90 AND points >= 3) SELECT image, other, points, rank::INT AS rank FROM r WHERE rank <= 2""")
def best_partners(spark, sf_dir):
    s = views.pts(spark, sf_dir).groupBy(F.col("y").cast("long").alias("image"), F.col("classification").alias("other")).agg(F.count(F.lit(1)).alias("points"), F.avg("z").alias("angle"))
    found = extraction.best_partners(s, 2, 20.0, 90.0, 3)
    return found.select("image", "other", "points", F.col("rank").cast("int").alias("rank"))


# Every crossing of a level between two neighbouring cells is an end of two segments, or of one at the border of the squares.
@query("pts", f"""{DEM}, s AS (SELECT a.row, a.col, a.z AS a, b.z AS b, c.z AS c, e.z AS d FROM d a JOIN d b ON b.row = a.row AND b.col = a.col + 1 JOIN d c ON c.row = a.row + 1 AND c.col = a.col + 1 JOIN d e ON e.row = a.row + 1 AND e.col = a.col),
l AS (SELECT *, v::DOUBLE AS level FROM s, (VALUES (40), (60)) t(v) WHERE v > least(a, b, c, d) AND v <= greatest(a, b, c, d)),
x AS (SELECT *, ((a >= level) <> (b >= level))::INT + ((b >= level) <> (c >= level))::INT + ((c >= level) <> (d >= level))::INT + ((d >= level) <> (a >= level))::INT AS cuts,
CASE WHEN (a >= level) <> (b >= level) THEN col + .5 + (level - a) / (b - a) ELSE 0 END + CASE WHEN (b >= level) <> (c >= level) THEN col + 1.5 ELSE 0 END
+ CASE WHEN (c >= level) <> (d >= level) THEN col + 1.5 - (level - c) / (d - c) ELSE 0 END + CASE WHEN (d >= level) <> (a >= level) THEN col + .5 ELSE 0 END AS xs FROM l)
SELECT level, (sum(cuts) / 2)::BIGINT AS segments, round(sum(xs) * 30, 3) AS sum_x FROM x GROUP BY level""")
def contour_segments(spark, sf_dir):
    found = extraction.contour_segments(_dem(spark, sf_dir), 30.0, [40.0, 60.0])
    return found.groupBy("level").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum(F.col("x1") + F.col("x2")), 3).alias("sum_x"))


# ---- noise and streams --------------------------------------------------------------------------------------------------


@query("pts", """c AS (SELECT point_id, intensity * 250 AS r, classification * 5000 AS g, intensity * 255 AS b FROM pts),
s AS (SELECT *, greatest(r, g, b) AS m, CASE WHEN greatest(r, g, b) > 255 THEN 257.0 * 255 ELSE 255.0 END AS k FROM c WHERE r IS NOT NULL),
v AS (SELECT *, m / k AS high, CASE WHEN m > 0 THEN (m / k - least(r, g, b) / k) / (m / k) ELSE 0 END AS sat FROM s)
SELECT point_id FROM v WHERE (b >= r AND b >= g AND high > .55 AND sat < .65) OR (high > .88 AND sat < .12)""")
def sky_coloured(spark, sf_dir):
    i, c = F.col("intensity"), F.col("classification")
    p = views.pts(spark, sf_dir)
    return p.where(noise.sky_coloured(i * 250, c * 5000, i * 255)).select("point_id")


@query("vec3", """v AS (SELECT point_id, floor(x / .1)::BIGINT AS vx, floor(y / .1)::BIGINT AS vy, floor(z / .1)::BIGINT AS vz FROM vec3),
g AS MATERIALIZED (SELECT min(point_id) AS id, vx, vy, vz FROM v GROUP BY ALL), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a, g b WHERE abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a),
p AS (SELECT v.point_id, component FROM v JOIN g USING (vx, vy, vz) JOIN c USING (id)), n AS (SELECT component, count(*) AS n FROM p GROUP BY 1)
SELECT point_id, component, n FROM p JOIN n USING (component) WHERE n < 20 AND component <> (SELECT arg_max(component, (n, -component)) FROM n)""")
def small_clusters(spark, sf_dir):
    return noise.small_clusters(views.vec3(spark, sf_dir), 0.1, 20)


@query("pts", """l AS (SELECT DISTINCT classification AS c, point_id FROM pts WHERE z > 200)
SELECT point_id, rank::INT AS back FROM (SELECT point_id, row_number() OVER (ORDER BY point_id DESC) AS rank FROM pts WHERE z > 200) WHERE rank <= 30""")
def edit_history(spark, sf_dir):
    log = views.pts(spark, sf_dir).where("z > 200").select(F.col("point_id").alias("seq"), F.lit("command").alias("kind"))
    return points.history(log, 30).select(F.col("seq").alias("point_id"), F.col("back").cast("int").alias("back"))


@query("seabed", """b AS (SELECT floor(row / 3)::BIGINT AS row, floor(col / 3)::BIGINT AS col, max(z) AS z FROM seabed GROUP BY ALL) SELECT row, col, floor(-z * 100 + 1e-6) / 100 AS depth FROM b""")
def product_grid(spark, sf_dir):
    return hydrography.product_grid(views.seabed(spark, sf_dir), 3)


# ---- limits, holes, gaps, zones -----------------------------------------------------------------------------------------


@query("pts", "SELECT point_id, round(5 + .05 * abs(z), 6) AS thu, CASE WHEN abs(z) > 40 THEN round(.1 * abs(z), 6) ELSE 2 END::DOUBLE AS feature FROM pts")
def s44_sizes(spark, sf_dir):
    """Horizontal limits and feature sizes of order 1a."""
    p = views.pts(spark, sf_dir)
    rows = p.crossJoin(F.broadcast(hydrography.orders(spark).where("name = '1a'")))  # one row
    return rows.select("point_id", F.round(hydrography.thu(F.abs("z")), 6).alias("thu"), F.round(hydrography.feature_size("1a", F.abs("z")), 6).alias("feature"))


@query("pts", f"""{DEM}, s AS (SELECT row, col, CASE WHEN (row + col) % 3 > 0 THEN 1.5 END AS s FROM d) SELECT row, col, round(z - s, 4) AS z FROM d JOIN s USING (row, col)""")
def datum_apply_surface(spark, sf_dir):
    """Cells without a separation lose their height."""
    d = _dem(spark, sf_dir)
    s = F.when((F.col("row") + F.col("col")) % 3 > 0, F.lit(1.5))
    return hydrography.apply_separation(d, s, missing_keeps=False).select("row", "col", F.round("z", 4).alias("z"))


# Cells of a field of 9 rows: a hole of one cell in every fifth cell of each third row; each is filled from its nearest neighbour, the first in order.
@query("pts", """d AS MATERIALIZED (SELECT floor(y / 4)::BIGINT AS row, floor(x / 4)::BIGINT AS col, round(avg(z), 4) AS z FROM pts GROUP BY ALL), h AS (SELECT row, col FROM d a WHERE row % 3 = 1 AND col % 5 = 2
AND (SELECT count(*) FROM d b WHERE b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1) = 9
AND a.col > (SELECT min(col) FROM d e WHERE e.row = a.row) AND a.col < (SELECT max(col) FROM d e WHERE e.row = a.row)),
k AS (SELECT * FROM d ANTI JOIN h USING (row, col)), n AS (SELECT h.row, h.col, k.z, sqrt((k.row - h.row) ** 2 + (k.col - h.col) ** 2) AS run, h.row - k.row AS dr, h.col - k.col AS dc FROM h JOIN k ON abs(k.row - h.row) <= 1 AND abs(k.col - h.col) <= 1)
SELECT row, col, arg_min(z, (run, -dr, -dc)) AS z FROM n GROUP BY row, col""")
def filled_holes(spark, sf_dir):
    d = saved(grid.build_dem(views.pts(spark, sf_dir), 4.0, "mean").withColumn("z", F.round("z", 4)))
    full = flow._ring(d).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where("n = 8")
    punched = saved(d.join(full, ["row", "col"]).where("row % 3 = 1 and col % 5 = 2").select("row", "col"))
    left = saved(d.join(punched, ["row", "col"], "left_anti"))
    return flow.fill_holes(left, 1).join(punched, ["row", "col"], "left_semi").select("row", "col", "z")


@query("profile", """k AS (SELECT route_id, ch, z, lead(ch) OVER w AS c1, lead(z) OVER w AS z1 FROM profile WHERE point_id % 2 = 0 WINDOW w AS (PARTITION BY route_id ORDER BY ch, point_id)),
a AS (SELECT p.route_id, p.point_id, p.ch, k.ch AS c0, k.z AS z0, k.c1, k.z1 FROM profile p JOIN k ON k.route_id = p.route_id AND p.ch > k.ch AND p.ch < k.c1 WHERE p.point_id % 2 = 1)
SELECT route_id, point_id AS key, round(CASE WHEN c1 - c0 <= 30 THEN z0 + (z1 - z0) * (ch - c0) / (c1 - c0) END, 5) AS z FROM a""")
def interpolated_runs(spark, sf_dir):
    """Levels between known stations, none where these are over 30 m apart."""
    p = views.profile(spark, sf_dir)
    asked = p.where("point_id % 2 = 1").select("route_id", F.col("point_id").alias("key"), "ch")
    known = p.where("point_id % 2 = 0")
    found = routes.interpolate(asked, known, "ch", ("z",), clamp=False, max_gap=30.0)
    ends = known.groupBy("route_id").agg(F.min("ch").alias("a"), F.max("ch").alias("b"))
    inside = found.join(ends, "route_id").where("ch > a and ch < b")
    return inside.select("route_id", "key", F.round("z", 5).alias("z"))


@query("structures", """p AS (SELECT name, x * 2 AS lon, y * 2 - 25 AS lat FROM structures)
SELECT name, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(60, greatest(1, floor((lon + 180) / 6) + 1)))::INT AS epsg, true AS allowed FROM p""")
def utm_zones(spark, sf_dir):
    zone = crs.utm_epsg(F.col("x") * 2, F.col("y") * 2 - 25)
    return views.structures(spark, sf_dir).select("name", zone.alias("epsg"), crs.product_epsg_allowed(zone).alias("allowed"))


@query("", "SELECT o_orderkey AS point_id, round(date_diff('day', DATE '1992-01-01', o_orderdate::DATE) / 365.25, 6) AS years FROM orders")
def years_between(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    years = routes.years_between(F.lit("1992-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return o.select(F.col("o_orderkey").alias("point_id"), F.round(years, 6).alias("years"))


# A feature is matched to the one of the same number on the next image, so a track is a run of images.
@query("route_vertex", """k AS (SELECT route_id AS i, seq AS f, route_id - dense_rank() OVER (ORDER BY route_id) AS run FROM route_vertex),
t AS (SELECT f, i, i - row_number() OVER (PARTITION BY f ORDER BY i) AS g FROM k), n AS (SELECT f, g, count(*) AS n, min(i) * 4294967296 + f AS track FROM t GROUP BY f, g)
SELECT track, i AS image, f AS feature FROM t JOIN n USING (f, g) WHERE n >= 2""")
def feature_tracks(spark, sf_dir):
    v = views.route_vertex(spark, sf_dir).select("route_id", F.col("seq").cast("long").alias("seq"))
    after = v.select((F.col("route_id") - 1).alias("route_id"), "seq")
    m = v.join(after, ["route_id", "seq"]).select(F.col("route_id").alias("image_a"), F.col("seq").alias("feature_a"), (F.col("route_id") + 1).alias("image_b"), F.col("seq").alias("feature_b"))
    return extraction.build_tracks(m).select("track", "image", "feature")


CAMERAS = [dict(cx=100.0 * i, cy=50.0, cz=-400.0, r=[[1, 0, 0], [0, 1, 0], [0, 0, 1]], f=500.0, px=400.0, py=300.0, w=800.0, h=600.0) for i in range(8)]
VIEWS = ", ".join(f"({i}, {100.0 * i}::DOUBLE)" for i in range(8))


@query("pts", f"""c(cam, cx) AS (VALUES {VIEWS}), s AS (SELECT point_id, cam, z + 400 AS depth, 500 * (x - cx) / (z + 400) + 400 AS u, 500 * (y - 50) / (z + 400) + 300 AS v FROM pts, c),
i AS (SELECT *, floor(u / 24)::BIGINT AS bu, floor(v / 24)::BIGINT AS bv FROM s WHERE depth > 0 AND u BETWEEN 0 AND 800 AND v BETWEEN 0 AND 600),
r AS (SELECT *, row_number() OVER (PARTITION BY cam, bu, bv ORDER BY depth) - 1 AS k, count(*) OVER (PARTITION BY cam, bu, bv) AS n FROM i),
f AS (SELECT *, max(CASE WHEN k = (3 * n) // 4 THEN depth END) OVER (PARTITION BY cam, bu, bv) AS far FROM r), g AS (SELECT *, (depth < far * .95)::INT AS near FROM f),
h AS (SELECT *, (near = 1 AND avg(near) OVER (PARTITION BY cam, bu, bv) < .5 AND n >= 4)::INT AS hit FROM g), t AS (SELECT point_id, sum(hit)::BIGINT AS hits, count(*) AS views FROM h GROUP BY 1)
SELECT point_id, hits, views FROM t WHERE hits >= 2 AND 2 * hits >= views""")
def free_space(spark, sf_dir):
    return noise.free_space(views.pts(spark, sf_dir), CAMERAS)
