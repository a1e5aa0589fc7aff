"""Contours, cloud-to-cloud distances, and the relational parts of photogrammetry."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bathyal.functions.expressions import cell as cell_of
from bathyal.operators.graph import chained, components, saved
from bathyal.operators.knn import pairs_within


def contour_segments(surface: DataFrame, cell: float, levels: Sequence[float]) -> DataFrame:
    """level, x1, y1, x2, y2: where each square of four neighbouring cell centres is cut by each level.

    A square is split at its centre's mean when two opposite corners lie above the level. Corners at a level count as above.
    """
    square = surface.select("row", "col", F.col("z").alias("a"))
    for name, dr, dc in (("b", 0, 1), ("c", 1, 1), ("d", 1, 0)):
        square = square.join(surface.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("z").alias(name)), ["row", "col"])
    low, high = F.least("a", "b", "c", "d"), F.greatest("a", "b", "c", "d")
    cut = square.withColumn("level", F.explode(F.filter(F.array(*[F.lit(float(v)) for v in levels]), lambda v: (v > low) & (v <= high))))
    x0, y0 = (F.col("col") + 0.5) * cell, (F.col("row") + 0.5) * cell
    level = F.col("level")

    def crossing(p: str, q: str, px: float, py: float, qx: float, qy: float):
        t = F.try_divide(level - F.col(p), F.col(q) - F.col(p))
        hit = (F.col(p) >= level) != (F.col(q) >= level)
        return F.when(hit, F.struct((x0 + (px + (qx - px) * t) * cell).alias("x"), (y0 + (py + (qy - py) * t) * cell).alias("y")))

    cut = cut.withColumns({"s": crossing("a", "b", 0, 0, 1, 0), "e": crossing("b", "c", 1, 0, 1, 1), "n": crossing("c", "d", 1, 1, 0, 1), "w": crossing("d", "a", 0, 1, 0, 0)})
    up = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 >= level
    line = lambda p, q: F.struct(F.col(p).alias("p"), F.col(q).alias("q"))
    saddle = F.col("s").isNotNull() & F.col("e").isNotNull() & F.col("n").isNotNull() & F.col("w").isNotNull()
    joined = (F.col("a") >= level) == up
    two = F.when(joined, F.array(line("s", "e"), line("n", "w"))).otherwise(F.array(line("s", "w"), line("e", "n")))
    there = F.filter(F.array("s", "e", "n", "w"), lambda p: p.isNotNull())
    one = F.array(F.struct(F.get(there, F.lit(0)).alias("p"), F.get(there, F.lit(1)).alias("q")))
    lines = cut.select("level", F.explode(F.when(saddle, two).otherwise(one)).alias("l"))
    return lines.select("level", F.col("l.p.x").alias("x1"), F.col("l.p.y").alias("y1"), F.col("l.q.x").alias("x2"), F.col("l.q.y").alias("y2"))


def contour_vertices(segments: DataFrame) -> DataFrame:
    """level, line, seq, x, y: segments (level, x1, y1, x2, y2) chained end to end; a closed line ends where it begins.

    Every segment is a link in both directions, and the link after it is one of another segment that begins where it ends, so a
    line comes out twice, once each way; the one of smaller name stays. Lines are spread over tasks like their segments.
    """
    key = lambda x, y: F.xxhash64("level", F.round(x, 6), F.round(y, 6))
    ends = segments.withColumns({"a": key("x1", "y1"), "b": key("x2", "y2")}).where("a <> b")
    ends = saved(ends.withColumn("id", F.monotonically_increasing_id() * 2))
    side = lambda id_, x, y, u, v, start, end: F.struct(id_.alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(u).alias("u"), F.col(v).alias("v"), F.col(start).alias("start"), F.col(end).alias("end"))
    both = F.array(side(F.col("id"), "x1", "y1", "x2", "y2", "a", "b"), side(F.col("id") + 1, "x2", "y2", "x1", "y1", "b", "a"))
    directed = saved(ends.select("level", F.explode(both).alias("s")).select("level", "s.*"))
    # at each place the segments that meet there are taken two by two; leaving one means having come by the other
    pairs = directed.select(F.col("start").alias("end"), "id").withColumn("rank", F.row_number().over(Window.partitionBy("end").orderBy("id")) - 1)
    pair = F.floor(F.col("rank") / 2)
    meets = pairs.select("end", pair.alias("pair"), F.col("id").alias("nxt"), (F.col("id").bitwiseXOR(F.lit(1))).alias("came"))
    nxt = meets.alias("p").join(meets.alias("q"), (F.col("p.end") == F.col("q.end")) & (F.col("p.pair") == F.col("q.pair")) & (F.col("p.nxt") != F.col("q.nxt")))
    links = directed.select("id").join(nxt.select(F.col("p.came").alias("id"), F.col("q.nxt").alias("nxt")), "id", "left")
    chain = saved(chained(links))
    other = chain.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.col("chain").alias("mirror"))
    kept = directed.join(chain.join(other, "id").where("chain <= mirror").select("id", "chain", "left"), "id")
    last = F.when(F.col("left") == 0, F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.col("u").alias("x"), F.col("v").alias("y"))))
    points = F.concat(F.array(F.struct((-F.col("left") - 1).alias("seq"), F.col("x").alias("x"), F.col("y").alias("y"))), F.coalesce(last, F.array().cast("array<struct<seq:bigint,x:double,y:double>>")))
    return kept.select("level", F.col("chain").alias("line"), F.explode(points).alias("p")).select("level", "line", "p.*")


def contour_lines(segments: DataFrame) -> DataFrame:
    """level, line, points: the vertices of each chained line as an array."""
    ordered = contour_vertices(segments).groupBy("level", "line").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    return ordered.select("level", "line", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def line_length(points: Column) -> Column:
    """The length of an array of points, a column expression."""
    pairs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)


def cloud_distances(core: DataFrame, a: DataFrame, b: DataFrame, normal_scale: float, diameter: float, depth: float, reg_error: float = 0.0) -> DataFrame:
    """point_id, distance, lod, significant: per core point the difference of both clouds' means along its normal.

    The normal is that of cloud a within normal_scale / 2 (upwards; three points at least); the means are of points in a
    cylinder of the given diameter and half length, two at least; lod is 1.96 standard errors (sample) plus reg_error.
    """
    place = lambda df, p: df.select(F.col("point_id").alias("b"), *[F.col(c).alias(f"{p}{c}") for c in ("x", "y", "z")])
    near = pairs_within(core, a, normal_scale / 2).join(place(a, "p"), "b").groupBy("a")
    names = [("px", "px"), ("px", "py"), ("px", "pz"), ("py", "py"), ("py", "pz"), ("pz", "pz")]
    moments = near.agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(p, q).alias(f"c{i}") for i, (p, q) in enumerate(names)])

    @F.pandas_udf("nx double, ny double, nz double")
    def normal(n: pd.Series, c0: pd.Series, c1: pd.Series, c2: pd.Series, c3: pd.Series, c4: pd.Series, c5: pd.Series) -> pd.DataFrame:
        m = np.stack([np.stack([c0, c1, c2], 1), np.stack([c1, c3, c4], 1), np.stack([c2, c4, c5], 1)], 1)
        v = np.linalg.eigh(m)[1][:, :, 0] if len(m) else np.zeros((0, 3))
        v = np.where(v[:, 2:3] < 0, -v, v)
        v[n.to_numpy() < 3] = (0, 0, 1)
        return pd.DataFrame(v, columns=["nx", "ny", "nz"])

    normals = moments.select("a", normal("n", *[f"c{i}" for i in range(6)]).alias("v")).select("a", "v.*")
    start = core.select(F.col("point_id").alias("a"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz")).join(normals, "a")
    reach = math.hypot(diameter / 2, depth)

    def stats(cloud: DataFrame, p: str) -> DataFrame:
        rows = pairs_within(core, cloud, reach).join(place(cloud, "p"), "b").join(start, "a")
        d = [F.col(f"p{c}") - F.col(f"c{c}") for c in ("x", "y", "z")]
        along = d[0] * F.col("nx") + d[1] * F.col("ny") + d[2] * F.col("nz")
        across = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] - along * along
        inside = rows.select("a", along.alias("t"), across.alias("r2")).where((F.abs("t") <= depth) & (F.col("r2") <= diameter * diameter / 4))
        return inside.groupBy("a").agg(F.count(F.lit(1)).alias(f"n{p}"), F.avg("t").alias(f"m{p}"), F.var_samp("t").alias(f"v{p}")).where(F.col(f"n{p}") >= 2)

    both = stats(a, "1").join(stats(b, "2"), "a")
    lod = 1.96 * F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")) + reg_error
    distance = F.col("m2") - F.col("m1")
    return both.select(F.col("a").alias("point_id"), distance.alias("distance"), lod.alias("lod"), (F.abs(distance) > lod).alias("significant"))


# ---- photogrammetry ----------------------------------------------------------------------------------------------------


def select_pairs(images: DataFrame, window: int = 10) -> DataFrame:
    """Pairs of images (i) at most `window` apart in order; a join on the place, not on all pairs."""
    ahead = images.select(F.col("i").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(window))).alias("d")).withColumn("b", F.col("a") + F.col("d"))
    return ahead.join(images.select(F.col("i").alias("b")), "b", "left_semi").select("a", "b")


def select_gps_pairs(images: DataFrame, k: int = 12, start: float = 10.0) -> DataFrame:
    """Pairs of each image (point_id, x, y) with its k nearest, once each."""
    from bathyal.operators.knn import knn

    near = knn(images, images, k, start, axes=("x", "y"), same=True)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def build_tracks(matches: DataFrame, min_len: int = 2) -> DataFrame:
    """track, image, feature: connected features (image, feature), without tracks that hold an image twice or are too short.

    matches: image_a, feature_a, image_b, feature_b.
    """
    key = lambda i, f: F.shiftleft(F.col(i).cast("long"), 32) + F.col(f)
    edges = matches.select(key("image_a", "feature_a").alias("a"), key("image_b", "feature_b").alias("b"))
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    rows = components(nodes, edges).select(F.col("component").alias("track"), F.shiftright("id", 32).alias("image"), F.col("id").bitwiseAND((1 << 32) - 1).alias("feature"))
    sizes = rows.groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image").alias("images"))
    return rows.join(sizes.where((F.col("n") == F.col("images")) & (F.col("n") >= min_len)).select("track"), "track", "left_semi")


def voxel_reduce(points: DataFrame, voxel: float, min_views: int = 1) -> DataFrame:
    """Mean place and colour per voxel that enough different pairs (pair) have seen."""
    keys = [cell_of(c, voxel).alias(f"v{c}") for c in ("x", "y", "z")]
    means = [F.avg(c).alias(c) for c in ("x", "y", "z", "r", "g", "b") if c in points.columns]
    found = points.groupBy(*keys).agg(*means, F.count_distinct("pair").alias("views") if "pair" in points.columns else F.lit(min_views).alias("views"))
    return found.where(F.col("views") >= min_views).drop("vx", "vy", "vz")


def similarity(pairs: DataFrame, with_scale: bool = True) -> dict[str, np.ndarray | float]:
    """Scale, rotation and shift that take (sx, sy, sz) to (tx, ty, tz) with least squares.

    Sixteen sums over all pairs are one aggregate; the driver solves a 3 x 3 problem.
    """
    s, t = ["sx", "sy", "sz"], ["tx", "ty", "tz"]
    row = pairs.agg(
        *[F.avg(c).alias(c) for c in s + t], *[F.covar_pop(a, b).alias(f"{a}{b}") for a in t for b in s], sum(F.var_pop(c) for c in s).alias("var")
    ).first()
    cov = np.array([[row[f"{a}{b}"] for b in s] for a in t])
    u, d, vt = np.linalg.svd(cov)
    sign = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    r = u @ sign @ vt
    scale = float((d * np.diag(sign)).sum() / row["var"]) if with_scale else 1.0
    shift = np.array([row[c] for c in t]) - scale * r @ np.array([row[c] for c in s])
    return {"scale": scale, "rotation": r, "shift": shift}


def best_partners(shared: DataFrame, n: int = 2, min_angle: float = 3.0, max_angle: float = 40.0, min_shared: int = 30) -> DataFrame:
    """The n partner images with most shared points among those seen under a fair angle. shared: image, other, points, angle."""
    fair = shared.where(F.col("angle").between(min_angle, max_angle) & (F.col("points") >= min_shared))
    order = Window.partitionBy("image").orderBy(F.col("points").desc(), "other")
    return fair.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
