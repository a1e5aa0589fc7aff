"""Noise tests of point clouds: voxel clusters, colour, local planes and free space."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bathyal.functions.expressions import cell as cell_of
from bathyal.operators.graph import components
from bathyal.operators.knn import knn


def voxel_components(points: DataFrame, size: float) -> DataFrame:
    """point_id and component (the smallest point_id) of 26-connected voxels."""
    keys = ["vx", "vy", "vz"]
    keyed = points.select("point_id", *[cell_of(c, size).alias(k) for c, k in zip(("x", "y", "z"), keys)])
    voxels = keyed.groupBy(*keys).agg(F.min("point_id").alias("id"))
    ahead = [s for s in product((-1, 0, 1), repeat=3) if s > (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{k}") for v, k in zip(s, keys)]) for s in ahead])
    moved = voxels.select(F.col("id").alias("a"), *keys, F.explode(steps).alias("s"))
    moved = moved.select("a", *[(F.col(k) + F.col(f"s.d{k}")).alias(k) for k in keys])
    edges = moved.join(voxels.withColumnRenamed("id", "b"), keys).select("a", "b")
    found = components(voxels.select("id"), edges)
    return keyed.join(voxels, keys).join(found, "id").select("point_id", "component")


def small_clusters(points: DataFrame, radius: float = 0.5, min_points: int = 50, keep_largest: bool = True) -> DataFrame:
    """point_id of points in components of fewer than min_points; the largest component is spared."""
    member = voxel_components(points, radius)
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.where(F.col("n") < min_points)
    if keep_largest:
        largest = sizes.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("largest"))
        small = small.crossJoin(F.broadcast(largest)).where("component <> largest")  # largest is one row
    return member.join(small.select("component", "n"), "component").select("point_id", "component", "n")


def sky_coloured(r: Column, g: Column, b: Column) -> Column:
    """Blue and bright but not saturated, or nearly white. 16-bit colours are scaled down."""
    most = F.greatest(r, g, b)
    scale = F.when(most > 255, F.lit(257.0 * 255)).otherwise(F.lit(255.0))
    high, low = most / scale, F.least(r, g, b) / scale
    saturation = F.when(high > 0, (high - low) / high).otherwise(F.lit(0.0))
    return ((b >= r) & (b >= g) & (high > 0.55) & (saturation < 0.65)) | ((high > 0.88) & (saturation < 0.12))


def _gathered(points: DataFrame, k: int, start: float, own: bool) -> DataFrame:
    """point_id, x, y, z and the k neighbours' coordinates, as one flat array per axis."""
    near = knn(points, points, k, start, same=True)
    place = points.select(F.col("point_id").alias("b"), "x", "y", "z")
    lists = near.join(place, "b").groupBy("a").agg(*[F.sort_array(F.collect_list(F.struct("rank", c)))[c].alias(f"n{c}") for c in ("x", "y", "z")])
    out = points.join(lists.withColumnRenamed("a", "point_id"), "point_id")
    if own:
        for c in ("x", "y", "z"):
            out = out.withColumn(f"n{c}", F.concat(F.array(c), f"n{c}"))
    return out


def _planes(x: pd.Series, y: pd.Series, z: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours, their mean, and eigenvalues (rising) and vectors of their spread; rows of k neighbours each."""
    p = np.stack([np.vstack(c.to_numpy()) for c in (x, y, z)], axis=2)
    mean = p.mean(axis=1)
    d = p - mean[:, None, :]
    values, vectors = np.linalg.eigh(np.einsum("nki,nkj->nij", d, d) / p.shape[1])
    return p, mean, values, vectors


def local_planes(points: DataFrame, k: int = 16, start: float = 1.0, own: bool = True) -> DataFrame:
    """point_id, nx, ny, nz (the normal, upwards), variation (smallest share of the spread), residual and sigma.

    residual is the distance to the neighbours' plane; sigma is 1.4826 times the median of theirs.
    """

    @F.pandas_udf("nx double, ny double, nz double, variation double, residual double, sigma double")
    def fit(px: pd.Series, py: pd.Series, pz: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        if not len(px):
            return pd.DataFrame({c: [] for c in ("nx", "ny", "nz", "variation", "residual", "sigma")})
        p, mean, values, vectors = _planes(x, y, z)
        n = vectors[:, :, 0]
        n = np.where(n[:, 2:3] < 0, -n, n)
        me = np.column_stack([px, py, pz])
        residual = np.einsum("ni,ni->n", me - mean, n)
        others = np.abs(np.einsum("nki,ni->nk", p - mean[:, None, :], n))
        total = values.sum(axis=1)
        return pd.DataFrame(
            {
                "nx": n[:, 0],
                "ny": n[:, 1],
                "nz": n[:, 2],
                "variation": np.where(total > 0, values[:, 0] / np.where(total > 0, total, 1), 0.0),
                "residual": residual,
                "sigma": 1.4826 * np.median(others, axis=1),
            }
        )

    rows = _gathered(points, k, start, own)
    return rows.select("point_id", fit("x", "y", "z", "nx", "ny", "nz").alias("f")).select("point_id", "f.*")


def plane_outliers(points: DataFrame, k: int = 24, n_sigma: float = 4.0, min_sigma: float = 0.02, start: float = 1.0, side: str = "both") -> DataFrame:
    """Points farther from their neighbours' plane than n_sigma deviations."""
    fitted = local_planes(points, k, start, own=False)
    far = {"both": F.abs("residual"), "above": F.col("residual"), "below": -F.col("residual")}[side]
    return fitted.where(far > n_sigma * F.greatest("sigma", F.lit(min_sigma))).select("point_id", "residual", "sigma")


def free_space(points: DataFrame, cameras: Sequence[dict], bin_px: int = 24, rel: float = 0.05, min_cams: int = 2, max_frac: float = 0.5) -> DataFrame:
    """Points that stand in front of what several cameras see behind them.

    cameras: dicts of cx, cy, cz, r (three rows), f, px, py, w, h; a list of bounded length, which is sent as literals.
    """
    from pyspark.sql import Window

    rows = []
    for i, c in enumerate(cameras):
        d = [F.col(a) - float(c[b]) for a, b in (("x", "cx"), ("y", "cy"), ("z", "cz"))]
        u, v, w = (sum(float(m) * e for m, e in zip(r, d)) for r in c["r"])
        rows.append(F.struct(F.lit(i).alias("cam"), (c["f"] * u / w + c["px"]).alias("u"), (c["f"] * v / w + c["py"]).alias("v"), w.alias("depth"), F.lit(c["w"]).alias("width"), F.lit(c["h"]).alias("height")))
    seen = points.select("point_id", F.explode(F.array(*rows)).alias("s")).select("point_id", "s.*")
    seen = seen.where((F.col("depth") > 0) & F.col("u").between(0, F.col("width")) & F.col("v").between(0, F.col("height")))
    seen = seen.withColumns({"bu": cell_of("u", bin_px), "bv": cell_of("v", bin_px)})
    w = Window.partitionBy("cam", "bu", "bv")
    seen = seen.withColumns({"rank": F.row_number().over(w.orderBy("depth")) - 1, "n": F.count(F.lit(1)).over(w)})
    far = F.max(F.when(F.col("rank") == F.floor(3 * F.col("n") / 4), F.col("depth"))).over(w)
    seen = seen.withColumn("near", (F.col("depth") < far * (1 - rel)).cast("int"))
    seen = seen.withColumn("hit", ((F.col("near") == 1) & (F.avg("near").over(w) < max_frac) & (F.col("n") >= 4)).cast("int"))
    per = seen.groupBy("point_id").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("views"))
    return per.where((F.col("hits") >= min_cams) & (2 * F.col("hits") >= F.col("views")))
