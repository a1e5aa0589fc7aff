"""Bundle adjustment: camera poses and places of points that fit all observations best, with outliers damped.

Observations of a point are a track. Tracks are dealt to groups by hash; a group works out residuals and derivatives of its tracks
in numpy, eliminates each point (a 3 x 3 block) and is left with blocks of 6 x 6 for pairs of cameras that share a track, summed
over the group. Spark sums these blocks by pair. The system of the cameras, six numbers for each, is solved on the driver, and
the groups then move their own points. No task and no driver ever holds the points or observations as a whole.

Poses take a place X to R X + t, along the camera's z. A step turns R by a small rotation from the left.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bathyal.operators.graph import saved

#: Observations of a group of tracks, about.
GROUP = 20_000
#: Cameras that the driver solves for at once.
MOST_CAMERAS = 2000
BLOCK = [f"s{k}" for k in range(36)] + [f"g{k}" for k in range(6)]


class Lens(NamedTuple):
    """Focal length and middle in pixels, and radial distortion."""

    f: float
    cx: float
    cy: float
    k1: float = 0.0
    k2: float = 0.0


Poses = dict[int, tuple[np.ndarray, np.ndarray]]


def _crossed(v: np.ndarray) -> np.ndarray:
    """Matrices that take w to the cross product v x w."""
    out = np.zeros((*v.shape[:-1], 3, 3))
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    return out - np.swapaxes(out, -1, -2)


def rotation(w: np.ndarray) -> np.ndarray:
    """The matrix of a turn about an axis by its length, in radians."""
    angle = float(np.linalg.norm(w))
    if angle < 1e-12:
        return np.eye(3) + _crossed(w)
    k = _crossed(w / angle)
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


def observed(x: np.ndarray, r: np.ndarray, t: np.ndarray, lens: Lens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels of places (n, 3) under a pose each, and their derivatives by pose (n, 2, 6) and by place (n, 2, 3)."""
    turned = np.einsum("nij,nj->ni", r, x)
    p = turned + t
    z = np.where(np.abs(p[:, 2]) > 1e-9, p[:, 2], 1e-9)
    a, b = p[:, 0] / z, p[:, 1] / z
    r2 = a * a + b * b
    bend, slope = 1 + lens.k1 * r2 + lens.k2 * r2 * r2, 2 * (lens.k1 + 2 * lens.k2 * r2)
    pixel = np.stack([lens.f * bend * a + lens.cx, lens.f * bend * b + lens.cy], 1)
    by_ab = lens.f * np.stack([np.stack([bend + a * a * slope, a * b * slope], 1), np.stack([a * b * slope, bend + b * b * slope], 1)], 1)
    zero = np.zeros_like(z)
    by_p = by_ab @ np.stack([np.stack([1 / z, zero, -a / z], 1), np.stack([zero, 1 / z, -b / z], 1)], 1)
    return pixel, np.concatenate([by_p @ -_crossed(turned), by_p], 2), by_p @ r


def _weights(residual: np.ndarray, loss: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and costs of residuals (n, 2): squares up to `loss` pixels, straight beyond (Huber)."""
    size = np.sqrt((residual * residual).sum(1))
    far = size > loss
    return np.where(far, loss / np.maximum(size, 1e-300), 1.0), np.where(far, 2 * loss * size - loss * loss, size * size)


class _Tracks(NamedTuple):
    """The observations of a group's points, in order of points: which point and camera each is of."""

    ids: np.ndarray
    places: np.ndarray
    point: np.ndarray
    camera: np.ndarray
    seen: np.ndarray


def _tracks(rows: pd.DataFrame) -> _Tracks:
    rows = rows.sort_values(["point_id", "camera", "u", "v"], kind="stable")
    ids, first, point = np.unique(rows["point_id"].to_numpy(), return_index=True, return_inverse=True)
    return _Tracks(ids, rows[["x", "y", "z"]].to_numpy()[first], point, rows["camera"].to_numpy(), rows[["u", "v"]].to_numpy())


def _parts(tracks: _Tracks, turn: np.ndarray, shift: np.ndarray, lens: Lens, loss: float, damping: float):
    """Derivatives by pose, weighted; what couples pose and place; inverse blocks and right sides of points; residuals and costs."""
    pixel, by_pose, by_place = observed(tracks.places[tracks.point], turn[tracks.camera], shift[tracks.camera], lens)
    miss = tracks.seen - pixel
    w, cost = _weights(miss, loss)
    n = len(tracks.ids)
    v, b = np.zeros((n, 3, 3)), np.zeros((n, 3))
    np.add.at(v, tracks.point, w[:, None, None] * np.swapaxes(by_place, 1, 2) @ by_place)
    np.add.at(b, tracks.point, w[:, None] * np.einsum("nki,nk->ni", by_place, miss))
    diagonal = np.arange(3)
    v[:, diagonal, diagonal] += damping * np.maximum(v[:, diagonal, diagonal], 1e-9)
    couple = w[:, None, None] * np.swapaxes(by_pose, 1, 2) @ by_place  # (n, 6, 3)
    return by_pose, couple, np.linalg.inv(v), b, miss, w, cost


def reduced(tracks: _Tracks, turn: np.ndarray, shift: np.ndarray, lens: Lens, loss: float, damping: float) -> pd.DataFrame:
    """Blocks (i, j, s0 to s35, g0 to g5, cost) of the cameras' system without its points; right sides and costs stand at i = j."""
    by_pose, couple, inverse, b, miss, w, cost = _parts(tracks, turn, shift, lens, loss, damping)
    counts = np.bincount(tracks.point)
    starts = np.cumsum(counts) - counts
    one = np.repeat(np.arange(len(tracks.point)), counts[tracks.point])
    ends = np.cumsum(counts[tracks.point])
    other = starts[tracks.point][one] + np.arange(len(one)) - (ends - counts[tracks.point])[one]
    left = couple @ inverse[tracks.point]
    pairs = -left[one] @ np.swapaxes(couple[other], 1, 2)
    own = w[:, None, None] * np.swapaxes(by_pose, 1, 2) @ by_pose
    right = w[:, None] * np.einsum("nki,nk->ni", by_pose, miss) - np.einsum("nij,nj->ni", left, b[tracks.point])
    m = len(turn)
    key = np.concatenate([tracks.camera * m + tracks.camera, tracks.camera[one] * m + tracks.camera[other]])
    keys, at = np.unique(key, return_inverse=True)
    blocks, sides, costs = np.zeros((len(keys), 6, 6)), np.zeros((len(keys), 6)), np.zeros(len(keys))
    np.add.at(blocks, at, np.concatenate([own, pairs]))
    np.add.at(sides, at[: len(w)], right)
    np.add.at(costs, at[: len(w)], cost)
    out = pd.DataFrame(np.concatenate([blocks.reshape(-1, 36), sides], 1), columns=BLOCK)
    out.insert(0, "i", keys // m)
    out.insert(1, "j", keys % m)
    return out.assign(cost=costs)


def places_after(tracks: _Tracks, turn: np.ndarray, shift: np.ndarray, lens: Lens, loss: float, damping: float, step: np.ndarray) -> np.ndarray:
    """Where the points go once the cameras have taken a step (m, 6)."""
    _, couple, inverse, b, _, _, _ = _parts(tracks, turn, shift, lens, loss, damping)
    rest = b.copy()
    np.add.at(rest, tracks.point, -np.einsum("nij,ni->nj", couple, step[tracks.camera]))
    return tracks.places + np.einsum("nij,nj->ni", inverse, rest)


def adjust(observations: DataFrame, points: DataFrame, poses: Poses, lens: Lens, loss: float = 4.0, rounds: int = 20, fixed: Iterable[int] = (), tolerance: float = 1e-8) -> tuple[Poses, DataFrame, list[float]]:
    """Poses and points (point_id, x, y, z) after up to `rounds` damped steps, and the cost before each and after the last.

    observations: point_id, image, u, v; points: point_id, x, y, z; poses: rotation and shift of each image. Observations of images
    without a pose, of points that aren't there or without finite pixels take no part, and points that fewer than two images see
    stay where they are. fixed: images whose pose is kept. A step that doesn't lower the cost is tried again with more damping.
    """
    images = sorted(poses)
    if len(images) > MOST_CAMERAS:
        raise ValueError(f"the cameras' system is solved at once for up to {MOST_CAMERAS} images")
    spark = observations.sparkSession
    index = spark.createDataFrame([(i, k) for k, i in enumerate(images)], "image int, camera int")
    turn, shift = (np.stack([np.asarray(poses[i][k], float) for i in images]) for k in (0, 1))
    kept = np.array([i in set(fixed) for i in images])
    rows = observations.where("u is not null and v is not null and not isnan(u) and not isnan(v)").join(F.broadcast(index), "image")  # MOST_CAMERAS rows
    many = rows.groupBy("point_id").agg(F.count_distinct("camera").alias("n")).where("n >= 2").select("point_id")
    rows = saved(rows.join(many, "point_id", "left_semi").join(points.select("point_id", "x", "y", "z"), "point_id").select("point_id", "camera", "u", "v", "x", "y", "z"))
    groups = max(1, -(-rows.count() // GROUP))
    key = F.pmod(F.xxhash64("point_id"), F.lit(groups)).alias("group")
    moving = np.repeat(~kept, 6)
    shape = "i long, j long, " + ", ".join(f"{c} double" for c in [*BLOCK, "cost"])
    sums = [F.sum(c).alias(c) for c in [*BLOCK, "cost"]]

    def system(now: DataFrame, turn: np.ndarray, shift: np.ndarray, damping: float) -> tuple[np.ndarray, np.ndarray, float]:
        blocks = now.groupBy(key).applyInPandas(lambda g: reduced(_tracks(g), turn, shift, lens, loss, damping), shape).groupBy("i", "j").agg(*sums).toPandas()
        m = len(images)
        s, g = np.zeros((m, 6, m, 6)), np.zeros((m, 6))
        for i, j, block in zip(blocks["i"], blocks["j"], blocks[BLOCK].to_numpy(), strict=True):
            s[i, :, j] += block[:36].reshape(6, 6)
            g[i] += block[36:]
        return s.reshape(6 * m, 6 * m), g.ravel(), float(blocks["cost"].sum())

    def stepped(now: DataFrame, turn: np.ndarray, shift: np.ndarray, damping: float, step: np.ndarray) -> DataFrame:
        def go(g: pd.DataFrame) -> pd.DataFrame:
            tracks = _tracks(g)
            new = places_after(tracks, turn, shift, lens, loss, damping, step)[tracks.point]
            return pd.DataFrame({"point_id": tracks.ids[tracks.point], "camera": tracks.camera, "u": tracks.seen[:, 0], "v": tracks.seen[:, 1], "x": new[:, 0], "y": new[:, 1], "z": new[:, 2]})

        return saved(now.groupBy(key).applyInPandas(go, now.schema))

    damping, costs = 1e-4, []
    s, g, cost = system(rows, turn, shift, damping)
    costs.append(cost)
    for _ in range(rounds):
        diagonal = np.arange(len(s))
        full = s.copy()
        full[diagonal, diagonal] += damping * np.maximum(np.abs(s[diagonal, diagonal]), 1e-9)
        step = np.zeros(len(s))
        step[moving] = np.linalg.lstsq(full[np.ix_(moving, moving)], g[moving], rcond=None)[0]
        step = step.reshape(-1, 6)
        new_turn, new_shift = np.stack([rotation(w) @ r for w, r in zip(step[:, :3], turn, strict=True)]), shift + step[:, 3:]
        moved = stepped(rows, turn, shift, damping, step)
        calmer = max(damping / 10, 1e-12)
        new_s, new_g, new_cost = system(moved, new_turn, new_shift, calmer)
        if new_cost < cost:
            done = cost - new_cost <= tolerance * max(cost, 1e-300)
            rows, turn, shift, damping, s, g, cost = moved, new_turn, new_shift, calmer, new_s, new_g, new_cost
            costs.append(cost)
            if done:
                break
        else:
            damping *= 10
            if damping > 1e6:
                break
            s, g, cost = system(rows, turn, shift, damping)
    found = rows.groupBy("point_id").agg(*[F.first(c).alias(f"n{c}") for c in "xyz"])
    out = points.join(found, "point_id", "left").select("point_id", *[F.coalesce(f"n{c}", c).alias(c) for c in "xyz"])
    return {i: (turn[k], shift[k]) for k, i in enumerate(images)}, out, costs
