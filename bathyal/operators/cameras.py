"""Geometry of cameras as column expressions: rotation, projection, distortion, angles, similarity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def rotate(p: Vector, turn: Vector) -> Vector:
    """p turned about an axis; the turn's length is the angle in radians."""
    angle = F.sqrt(dot(turn, turn))
    axis = tuple(F.when(angle > 1e-12, t / angle).otherwise(F.lit(0.0)) for t in turn)
    side, along = cross(axis, p), dot(p, axis) * (1 - F.cos(angle))
    return tuple(F.cos(angle) * a + F.sin(angle) * b + along * c for a, b, c in zip(p, side, axis))


def transformed(p: Vector, matrix: Sequence[Sequence[float]], shift: Sequence[float], scale: float = 1.0) -> Vector:
    """scale * matrix * p + shift."""
    return tuple(scale * (p[0] * float(r[0]) + p[1] * float(r[1]) + p[2] * float(r[2])) + float(s) for r, s in zip(matrix, shift))


def pixel(p: Vector, f: float, cx: float, cy: float, k1: float = 0.0, k2: float = 0.0) -> tuple[Column, Column, Column]:
    """u, v and depth of a place in a camera's own axes, with radial distortion; none behind the camera."""
    x, y = p[0] / p[2], p[1] / p[2]
    r2 = x * x + y * y
    bend = 1 + k1 * r2 + k2 * r2 * r2
    seen = lambda c: F.when(p[2] > 0, c)
    return seen(f * bend * x + cx), seen(f * bend * y + cy), p[2]


def undistorted(u: Column, v: Column, f: float, cx: float, cy: float, k1: float = 0.0, k2: float = 0.0, rounds: int = 8) -> tuple[Column, Column]:
    """Directions x / z and y / z of a pixel; radial distortion is undone by repeated division."""
    x0, y0 = (u - cx) / f, (v - cy) / f

    def closer(s: Column, _: Column) -> Column:
        r2 = s["x"] * s["x"] + s["y"] * s["y"]
        bend = 1 + k1 * r2 + k2 * r2 * r2
        return F.struct((x0 / bend).alias("x"), (y0 / bend).alias("y"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(x0.alias("x"), y0.alias("y")), closer)
    return found["x"], found["y"]


def view_angle(p: Vector, a: Vector, b: Vector) -> Column:
    """Degrees between the directions from p to two camera centres."""
    u, v = tuple(c - d for c, d in zip(p, a)), tuple(c - d for c, d in zip(p, b))
    size = F.greatest(F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)), F.lit(1e-30))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / size))))


def nearest_to_rays(a: Vector, u: Vector, b: Vector, v: Vector) -> Vector:
    """The place half way between two rays where they are nearest: from centres a and b along u and v."""
    w = tuple(c - d for c, d in zip(a, b))
    uu, uv, vv, uw, vw = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    bottom = uu * vv - uv * uv
    s, t = F.try_divide(uv * vw - vv * uw, bottom), F.try_divide(uu * vw - uv * uw, bottom)
    return tuple((a[i] + s * u[i] + b[i] + t * v[i]) / 2 for i in range(3))


def degenerate(places: DataFrame, ratio: float = 0.02) -> bool:
    """Whether the places (x, y, z) lie on a line, nearly. Six moments are one aggregate."""
    names = ("x", "y", "z")
    row = places.agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(a + b) for a in names for b in names]).first()
    if row["n"] < 3:
        return True
    size = np.sqrt(np.maximum(np.linalg.eigvalsh(np.array([[row[a + b] for b in names] for a in names])), 0))[::-1]
    return bool(size[0] <= 0 or size[1] / size[0] < ratio)
