"""Queries over routes, profiles and meshes, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bathyal.functions.expressions import round6
from bathyal.operators import mesh, routes
from bathyal.plans.registry import query
from bathyal.plans.tin import FACES
from bathyal.sources import views


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[round6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("route_vertex", "SELECT route_id, seq, round(cum, 6) AS cum FROM route_vertex")
def cum_chainage(spark, sf_dir):
    return _rounded(views.route_vertex(spark, sf_dir).select("route_id", F.col("seq").cast("long").alias("seq"), "cum"))


STATIONS = """e AS (SELECT route_id, max(cum) AS length FROM route_vertex GROUP BY 1),
s AS (SELECT route_id, k AS station, k * 500.0::DOUBLE AS ch FROM e, range(0, 100000) t(k) WHERE k <= floor(length / 500 + 1e-9)
UNION ALL SELECT route_id, floor(length / 500 + 1e-9)::BIGINT + 1, length FROM e WHERE length - floor(length / 500 + 1e-9) * 500 > 1e-6)"""


@query("route_vertex", f"""{STATIONS}, p AS (SELECT s.*, (SELECT struct_pack(c := max(v.cum)) FROM route_vertex v WHERE v.route_id = s.route_id AND v.cum <= s.ch).c AS c0 FROM s),
a AS (SELECT p.route_id, p.station, p.ch, arg_max(v.x, v.seq) AS x0, arg_max(v.y, v.seq) AS y0, any_value(c0) AS c0 FROM p JOIN route_vertex v ON v.route_id = p.route_id AND v.cum = p.c0 GROUP BY ALL),
b AS (SELECT a.*, n.c1, n.x1, n.y1 FROM a LEFT JOIN LATERAL (SELECT min(v.cum) AS c1, arg_min(v.x, v.seq) AS x1, arg_min(v.y, v.seq) AS y1 FROM route_vertex v WHERE v.route_id = a.route_id AND v.cum > a.ch) n ON true)
SELECT route_id, station, round(ch, 5) AS ch, round(CASE WHEN c1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (ch - c0) / (c1 - c0) END, 4) AS x,
round(CASE WHEN c1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (ch - c0) / (c1 - c0) END, 4) AS y FROM b""")
def stations_sampled(spark, sf_dir):
    v = views.route_vertex(spark, sf_dir)
    s = routes.stations(v, 500.0).select("route_id", F.col("station").cast("long").alias("key"), F.col("ch").alias("cum"))
    found = routes.xy_at(v, s)
    return found.select("route_id", F.col("key").alias("station"), F.round("cum", 5).alias("ch"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


EDGED = """g AS (SELECT *, coalesce((lag(ch) OVER w + ch) / 2, ch) AS lo, coalesce((lead(ch) OVER w + ch) / 2, ch) AS hi FROM profile WINDOW w AS (PARTITION BY route_id ORDER BY ch))"""


@query("profile", f"""{EDGED} SELECT route_id, floor(ch / 72 + 1e-9)::BIGINT AS bin, round(sum(hi - lo), 6) AS length, min(z) AS least, round(avg(z), 6) AS mean, max(z) AS most,
round(sum(CASE WHEN z > 50 THEN hi - lo ELSE 0 END) / sum(hi - lo) * 100, 6) AS ok_pct FROM g GROUP BY ALL""")
def kp_bins(spark, sf_dir):
    return _rounded(routes.chainage_bins(views.profile(spark, sf_dir), 72.0, "z", F.col("z") > 50))


RUNS = f"""{EDGED}, f AS (SELECT *, z < 60 AS flag FROM g),
t AS (SELECT *, coalesce((flag <> lag(flag) OVER (PARTITION BY route_id ORDER BY ch))::INT, 1) AS turn FROM f),
r AS (SELECT *, sum(turn) OVER (PARTITION BY route_id ORDER BY ch) AS run FROM t),
q AS (SELECT route_id, run, min(lo) AS ch_from, max(hi) AS ch_to, sum(hi - lo) AS length, count(*) AS n, avg(z) AS mean, min(z) AS extreme, arg_min(ch, (z, ch)) AS extreme_ch FROM r WHERE flag GROUP BY ALL)"""


@query("profile", f"{RUNS} SELECT route_id, round(ch_from, 6) AS ch_from, round(ch_to, 6) AS ch_to, round(length, 6) AS length, n, round(mean, 6) AS mean, extreme, round(extreme_ch, 6) AS extreme_ch FROM q")
def dob_segments(spark, sf_dir):
    return _rounded(routes.segments(views.profile(spark, sf_dir), F.col("z") < 60))


@query("profile", f"{RUNS} SELECT route_id, round(ch_from, 6) AS ch_from, round(length, 6) AS length FROM q WHERE length >= 20 - 1e-9")
def long_runs(spark, sf_dir):
    found = routes.segments(views.profile(spark, sf_dir), F.col("z") < 60)
    return _rounded(routes.long_segments(found, 20.0).select("route_id", "ch_from", "length"))


@query("profile", f"""{RUNS}, m AS (SELECT *, coalesce((ch_from - lag(ch_to) OVER (PARTITION BY route_id ORDER BY ch_from) > 12)::INT, 1) AS a FROM q),
k AS (SELECT *, sum(a) OVER (PARTITION BY route_id ORDER BY ch_from) AS g FROM m)
SELECT route_id, round(min(ch_from), 6) AS ch_from, round(max(ch_to), 6) AS ch_to, count(*) AS parts FROM k GROUP BY route_id, g""")
def merge_gaps(spark, sf_dir):
    found = routes.segments(views.profile(spark, sf_dir), F.col("z") < 60)
    return _rounded(routes.merge_gaps(found, 12.0))


@query("profile", f"""g AS (SELECT *, z - 40 AS dob, coalesce((lag(ch) OVER w + ch) / 2, ch) AS lo, coalesce((lead(ch) OVER w + ch) / 2, ch) AS hi FROM profile WINDOW w AS (PARTITION BY route_id ORDER BY ch))
SELECT route_id, round(min(dob), 6) AS least, round(avg(dob), 6) AS mean, round(sum(CASE WHEN dob >= 15 - 1e-4 THEN hi - lo ELSE 0 END), 6) AS compliant_m,
round(sum(CASE WHEN dob < 15 - 1e-4 AND dob > 1e-4 THEN hi - lo ELSE 0 END), 6) AS below_m, round(sum(CASE WHEN dob <= 1e-4 THEN hi - lo ELSE 0 END), 6) AS exposed_m FROM g GROUP BY 1""")
def dob_summary(spark, sf_dir):
    rows = views.profile(spark, sf_dir).select("route_id", "ch", F.col("z").alias("seabed"), F.lit(40.0).alias("top"))
    return _rounded(routes.cover(rows, 15.0))


@query("profile", """g AS (SELECT *, 40 - .2 - z AS gap, coalesce((lag(ch) OVER w + ch) / 2, ch) AS lo, coalesce((lead(ch) OVER w + ch) / 2, ch) AS hi FROM profile WINDOW w AS (PARTITION BY route_id ORDER BY ch)),
f AS (SELECT *, gap > .1 + 1e-4 AS flag FROM g), t AS (SELECT *, coalesce((flag <> lag(flag) OVER (PARTITION BY route_id ORDER BY ch))::INT, 1) AS turn FROM f),
r AS (SELECT *, sum(turn) OVER (PARTITION BY route_id ORDER BY ch) AS run FROM t)
SELECT route_id, round(min(lo), 6) AS ch_from, round(sum(hi - lo), 6) AS length, round(max(gap), 6) AS extreme, round(arg_min(ch, (-gap, ch)), 6) AS extreme_ch,
CASE WHEN sum(hi - lo) >= 10 - 1e-9 THEN 'SPAN' ELSE 'SHORT' END AS kind FROM r WHERE flag GROUP BY route_id, run""")
def span_profile(spark, sf_dir):
    rows = views.profile(spark, sf_dir).select("route_id", "ch", F.col("z").alias("seabed"), F.lit(40.0).alias("top"))
    return _rounded(routes.spans(rows).select("route_id", "ch_from", "length", "extreme", "extreme_ch", "kind"))


@query("profile", """SELECT route_id, point_id, round(least(z, min(z - 2 * ch) OVER (w ROWS UNBOUNDED PRECEDING) + 2 * ch, min(z + 2 * ch) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * ch), 6) AS shaved
FROM profile WINDOW w AS (PARTITION BY route_id ORDER BY ch, point_id)""")
def peak_shave(spark, sf_dir):
    return _rounded(routes.peak_shave(views.profile(spark, sf_dir), 2.0).select("route_id", "point_id", "shaved"))


@query("profile", """n AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY ch, point_id) AS k, count(*) OVER (PARTITION BY route_id) AS n FROM profile),
s AS (SELECT a.route_id, a.point_id, a.z, avg(b.z) AS long_wave FROM n a, range(-3, 4) t(d) JOIN n b ON b.route_id = a.route_id AND b.k = greatest(1, least(a.n, a.k + d)) GROUP BY ALL)
SELECT route_id, point_id, round(long_wave, 6) AS long_wave, round(z - long_wave, 6) AS bedform FROM s""")
def moving_mean(spark, sf_dir):
    return _rounded(routes.moving_mean(views.profile(spark, sf_dir), 3).select("route_id", "point_id", "long_wave", "bedform"))


XCORR = """h AS (SELECT floor(ch)::BIGINT AS i, route_id % 2 AS side, avg(z) AS v FROM profile GROUP BY ALL),
a AS (SELECT i, v FROM h WHERE side = 0), b AS (SELECT i, v FROM h WHERE side = 1)"""


@query("profile", f"{XCORR} SELECT d::INT AS lag, round(corr(a.v, b.v), 6) AS r, count(*) AS n FROM a, range(-5, 6) t(d) JOIN b ON b.i = a.i + d GROUP BY d")
def xcorr_lag(spark, sf_dir):
    rows = views.profile(spark, sf_dir).groupBy(F.floor("ch").alias("i"), (F.col("route_id") % 2).alias("side")).agg(F.avg("z").alias("v"))
    a, b = (rows.where(F.col("side") == s).select("i", "v") for s in (0, 1))
    return _rounded(routes.lag_correlation(a, b, 5))


HAUL = """m AS (SELECT route_id, floor(ch / 72)::BIGINT AS bin, sum(greatest(z - 60, 0)) AS cut, sum(greatest(60 - z, 0)) AS fill FROM profile GROUP BY ALL)"""


def _bins(spark, sf_dir):
    p = views.profile(spark, sf_dir)
    keyed = p.groupBy("route_id", F.floor(F.col("ch") / 72).alias("bin"))
    return keyed.agg(F.sum(F.greatest(F.col("z") - 60, F.lit(0.0))).alias("cut"), F.sum(F.greatest(60 - F.col("z"), F.lit(0.0))).alias("fill"))


@query("profile", f"{HAUL} SELECT route_id, bin, round(cut, 6) AS cut, round(fill, 6) AS fill FROM m")
def bin_cut_fill(spark, sf_dir):
    return _rounded(_bins(spark, sf_dir))


@query("profile", f"{HAUL} SELECT route_id, bin, round(cut, 6) AS cut, round(fill, 6) AS fill, round(sum(cut * .9 - fill) OVER (PARTITION BY route_id ORDER BY bin), 6) AS haul FROM m")
def mass_haul(spark, sf_dir):
    return _rounded(routes.mass_haul(_bins(spark, sf_dir)))


def _years(spark, sf_dir):
    p = views.profile(spark, sf_dir)
    return p.select("route_id", "ch", F.explode(F.array(*[F.lit(y) for y in (2024, 2025, 2026)])).alias("year"), "z").select(
        "route_id", "ch", "year", (F.col("z") / 20 - (F.col("year") - 2024) * 0.6).alias("dob")
    )


YEARS = "yr AS (SELECT route_id, ch, y AS year, z / 20 - (y - 2024) * .6 AS dob FROM profile, range(2024, 2027) t(y))"


@query("profile", f"""{YEARS}, g AS (SELECT *, coalesce((lag(ch) OVER w + ch) / 2, ch) AS lo, coalesce((lead(ch) OVER w + ch) / 2, ch) AS hi FROM yr WINDOW w AS (PARTITION BY route_id, year ORDER BY ch)),
f AS (SELECT *, dob < 1 - 1e-4 AS flag FROM g), t AS (SELECT *, coalesce((flag <> lag(flag) OVER (PARTITION BY route_id, year ORDER BY ch))::INT, 1) AS turn FROM f),
r AS (SELECT *, sum(turn) OVER (PARTITION BY route_id, year ORDER BY ch) AS run FROM t),
q AS (SELECT route_id, year, min(lo) AS ch_from, max(hi) AS ch_to FROM r WHERE flag GROUP BY route_id, year, run HAVING sum(hi - lo) >= 5 - 1e-9),
m AS (SELECT *, coalesce((ch_from - lag(ch_to) OVER (PARTITION BY route_id, year ORDER BY ch_from) > 20)::INT, 1) AS a FROM q),
k AS (SELECT *, sum(a) OVER (PARTITION BY route_id, year ORDER BY ch_from) AS g FROM m)
SELECT route_id, year::INT AS year, round(min(ch_from), 6) AS ch_from, round(max(ch_to), 6) AS ch_to, count(*) AS parts FROM k GROUP BY route_id, year, g""")
def multiyear_independent(spark, sf_dir):
    return _rounded(routes.reburial_years(_years(spark, sf_dir), 1.0, 20.0, 5.0))


@query("profile", f"""{YEARS}, a AS (SELECT route_id, ch, max(CASE WHEN year = 2024 THEN dob END) AS d1, max(CASE WHEN year = 2025 THEN dob END) AS d2, max(CASE WHEN year = 2026 THEN dob END) AS d3 FROM yr GROUP BY ALL),
b AS (SELECT *, d1 < 1 - 1e-4 AS c1, CASE WHEN d1 < 1 - 1e-4 THEN 1.5 - d1 ELSE 0 END AS s1 FROM a),
c AS (SELECT *, d2 + s1 < 1 - 1e-4 AS c2, CASE WHEN d2 + s1 < 1 - 1e-4 THEN 1.5 - d2 ELSE s1 END AS s2 FROM b), e AS (SELECT *, d3 + s2 < 1 - 1e-4 AS c3 FROM c)
SELECT route_id, round(ch, 6) AS ch, concat_ws(',', CASE WHEN c1 THEN 2024 END, CASE WHEN c2 THEN 2025 END, CASE WHEN c3 THEN 2026 END) AS campaigns FROM e""")
def multiyear_cumulative(spark, sf_dir):
    found = routes.reburial_campaigns(_years(spark, sf_dir), 1.0, 1.5)
    return found.select("route_id", F.round("ch", 6).alias("ch"), F.concat_ws(",", F.col("campaigns").cast("array<string>")).alias("campaigns"))


WIRE = [(0.0, 2.0, 20.0), (400.0, 10.0, 60.0)]


@query("pts", """a AS (SELECT *, greatest(0, least(sqrt(161664), (x * 400 + (y - 2) * 8 + (z - 20) * 40) / sqrt(161664))) AS t FROM pts),
d AS (SELECT *, sqrt((x - t * 400 / sqrt(161664)) ** 2 + (y - 2 - t * 8 / sqrt(161664)) ** 2 + (z - 20 - t * 40 / sqrt(161664)) ** 2) AS d FROM a),
n AS (SELECT point_id, classification, d, floor(t / 5)::BIGINT AS bin FROM d WHERE d < 5),
b AS (SELECT bin, bin - row_number() OVER (ORDER BY bin) AS run FROM (SELECT DISTINCT bin FROM n)),
c AS (SELECT run, classification, count(*) AS k, min(bin) AS b1, max(bin) AS b2, min((d, point_id)) AS near FROM n JOIN b USING (bin) GROUP BY ALL)
SELECT min(b1) AS bin_from, max(b2) AS bin_to, sum(k)::BIGINT AS n, round(min(near)[1], 6) AS least, min(near)[2] AS point_id, arg_max(classification, (k, -classification)) AS modal_class FROM c GROUP BY run""")
def clearance_segments(spark, sf_dir):
    return _rounded(routes.clearance(views.pts(spark, sf_dir), WIRE, 5.0, 5.0))


@query("seabed", f"""{FACES}, e AS (SELECT unnest([[ax, ay, bx, "by"], [bx, "by", cx, cy], [cx, cy, ax, ay]]) AS e FROM f),
u AS (SELECT CASE WHEN (e[1], e[2]) <= (e[3], e[4]) THEN e ELSE [e[3], e[4], e[1], e[2]] END AS e FROM e)
SELECT e[1]::DOUBLE AS x1, e[2]::DOUBLE AS y1, e[3]::DOUBLE AS x2, e[4]::DOUBLE AS y2 FROM u GROUP BY e HAVING count(*) = 1""")
def mesh_boundary_edges(spark, sf_dir):
    v, f = mesh.grid_mesh(views.seabed(spark, sf_dir), 30.0)
    at = lambda k: v.select(F.col("vid").alias(k), F.struct("x", "y").alias(f"p{k}"))
    found = mesh.boundary_edges(f).join(at("lo"), "lo").join(at("hi"), "hi")
    p, q = F.least("plo", "phi"), F.greatest("plo", "phi")
    return found.select(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))


@query("seabed", f"""{FACES}, k AS (SELECT (ax + bx + cx) / 3 AS x, (ay + "by" + cy) / 3 AS y, bx - ax AS ux, "by" - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz FROM f)
SELECT round(x, 3) AS x, round(y, 3) AS y, round(sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2) / 2, 5) AS area FROM k""")
def mesh_area(spark, sf_dir):
    """The area of every face, by its middle."""
    v, f = mesh.grid_mesh(views.seabed(spark, sf_dir), 30.0)
    middle = lambda c: F.round((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3, 3).alias(c)
    places = mesh.corners(f, v).select("mesh_id", "fid", middle("x"), middle("y"))
    return mesh.face_areas(f, v).join(places, ["mesh_id", "fid"]).select("x", "y", F.round("area", 5).alias("area"))
