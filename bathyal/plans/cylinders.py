"""Queries over piles and pipes, with SQL oracles that know the cylinders the tables were bent to."""

from __future__ import annotations

from pyspark.sql import functions as F

from bathyal.operators import cylinders, mesh
from bathyal.plans.registry import query
from bathyal.sources import views

#: Piles: middle x, y, lean along x for each metre of height. They have these radii and heights.
PILES = [(100.0, 50.0, 0.0), (140.0, 80.0, 0.1), (180.0, 40.0, -0.05)]
PILE_R, PILE_HEIGHT = (3.0, 2.0, 4.0), (9.0, 7.0, 12.0)
#: Pipes: a place, the direction and a vector across it, radius and length.
PIPES = [((500.0, 20.0, -30.0), (0.6, 0.64, 0.48), (0.8, -0.48, -0.36), 0.5, 20.0), ((560.0, 10.0, -20.0), (1.0, 0.0, 0.0), (0.0, 0.6, 0.8), 1.0, 30.0)]
#: Places on a surface by multiples of two numbers, which fill it evenly.
_ANGLE, _SHARE = "floor(point_id / 3) * 0.5698402909980532D * 2 * pi()", "pmod(floor(point_id / 3) * 0.7548776662466927D, 1D)"


#: _SHARE in DuckDB, whose doubles have no suffix.
_SHARE_SQL = "fmod(floor(point_id / 3) * 0.7548776662466927::DOUBLE, 1::DOUBLE)"


def _pile(k: int) -> str:
    (_, _, lean), height = PILES[k], PILE_HEIGHT[k]
    size = (1 + lean * lean) ** 0.5
    return f"""SELECT count(*) AS points, {PILE_R[k]}::DOUBLE AS radius, round((max(h) - min(h)) * {height}, 3) AS length,
        round(degrees(acos({1 / size})), 3) AS tilt FROM p WHERE part = {k} HAVING count(*) > 0"""


@query("vec3", f"p AS (SELECT point_id % 3 AS part, {_SHARE_SQL} AS h FROM vec3) {' UNION ALL '.join(map(_pile, range(3)))}")
def pile_segments(spark, sf_dir):
    """All vectors on three piles, two of them leaning: each comes back with its points, radius, length and tilt."""
    p = views.vec3(spark, sf_dir).select("point_id", (F.col("point_id") % 3).cast("int").alias("part"), F.expr(_ANGLE).alias("g"), F.expr(_SHARE).alias("s"))
    parts = []
    for k, ((x, y, lean), r, height) in enumerate(zip(PILES, PILE_R, PILE_HEIGHT, strict=True)):
        size = (1 + lean * lean) ** 0.5
        t = F.col("s") * height
        u, w = r * F.cos("g"), r * F.sin("g")  # across: (1, 0, -lean) / size and (0, 1, 0)
        place = (x + t * lean / size + u / size, y + w, t / size - u * lean / size)
        parts.append(p.where(F.col("part") == k).select("point_id", *[c.alias(n) for c, n in zip(place, "xyz", strict=True)]))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    facts, _ = cylinders.detect_cylinders(rows, limit=0.05, r_min=0.5, r_max=6.0, min_points=40, max_count=5, k=8)
    return facts.select("points", *[F.round(c, 3).alias(c) for c in ("radius", "length", "tilt")])


def _pipe(k: int) -> str:
    _, d, _, r, length = PIPES[k]
    return f"""SELECT count(*) AS points, {r}::DOUBLE AS radius, round((max(s) - min(s)) * {length}, 3) AS length,
        {d[0]}::DOUBLE AS ax, {d[1]}::DOUBLE AS ay, {d[2]}::DOUBLE AS az, round(pi() * {r * r} * (max(s) - min(s)) * {length} * {200 / 3.141592653589793 / 2} * sin(pi() / 100), 1) AS volume
        FROM p WHERE part = {k}"""


@query("pts", f"p AS (SELECT CASE WHEN point_id % 10 = 9 THEN 2 ELSE point_id % 2 END AS part, {_SHARE_SQL} AS s FROM pts) {' UNION ALL '.join(map(_pipe, range(2)))}")
def pipe_segments(spark, sf_dir):
    """All points on two pipes of any direction, but one in ten, which lie about: points, radius, length, axis, and the volume of the mesh."""
    bent = views.pts(spark, sf_dir).withColumns({"g": F.expr(_ANGLE), "s": F.expr(_SHARE)}).withColumns({"u": F.cos("g"), "v": F.sin("g")})
    part = F.when(F.col("point_id") % 10 == 9, 2).otherwise(F.col("point_id") % 2)
    place, normal = [F.lit(None).cast("double")] * 3, [F.lit(None).cast("double")] * 3
    for k, (at, d, u, r, length) in enumerate(PIPES):
        w = (d[1] * u[2] - d[2] * u[1], d[2] * u[0] - d[0] * u[2], d[0] * u[1] - d[1] * u[0])
        out = [u[i] * F.col("u") + w[i] * F.col("v") for i in range(3)]
        place = [F.when(part == k, at[i] + F.col("s") * length * d[i] + r * out[i]).otherwise(place[i]) for i in range(3)]
        normal = [F.when(part == k, out[i]).otherwise(normal[i]) for i in range(3)]
    loose = [500 + 60 * F.col("s"), F.pmod(F.col("g"), F.lit(60.0)), 40 + F.pmod(F.col("g") * 7, F.lit(90.0))]
    rows = bent.select("point_id", *[F.coalesce(c, e).alias(n) for c, e, n in zip(place, loose, "xyz", strict=True)], *[F.coalesce(c, F.lit(float(i == 0))).alias(f"n{'xyz'[i]}") for i, c in enumerate(normal)])
    facts, _ = cylinders.detect_cylinders(rows, limit=0.03, r_min=0.1, r_max=2.0, min_points=60, max_count=2, axis="any", normals=rows)
    vertices, faces = cylinders.cylinder_meshes(facts, sides=100)
    volume = mesh.volume(faces, vertices).select(F.col("mesh_id").alias("cylinder"), F.round("volume", 1).alias("volume"))
    kept = facts.join(volume, "cylinder")
    return kept.select("points", *[F.round(c, 3).alias(c) for c in ("radius", "length")], *[F.round(c, 4).alias(c) for c in ("ax", "ay", "az")], "volume")
