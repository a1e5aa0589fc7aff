"""Cylinders of a point cloud: piles, poles and pipes, many at a time.

Pairs of points with their normals, drawn by hashes in every cell of a grid, are hypotheses of an axis and a radius. A cell's points
choose among those of their own cell, so a hypothesis never meets the whole cloud. The best cells, a table of fixed size, are
refined together: a task adds up normal equations of its own rows for each, Spark sums them, and 5 x 5 systems are solved on the
driver. Points of what was found leave, and the next round begins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bathyal.functions.expressions import cell as cell_of
from bathyal.operators.cameras import Vector, cross, dot
from bathyal.operators.graph import saved
from bathyal.operators.knn import placed
from bathyal.operators.noise import local_planes

AXES = ("x", "y", "z")
NORMAL = ("nx", "ny", "nz")
#: Pairs that are drawn in a cell, and cells whose best hypothesis is refined in a round.
DRAWS, REFINED = 32, 64
#: Rounds of least squares; the last ones use the whole run of points.
#: The first ones take points within these shares of the radius, for normals of sparse points are rough.
SHARES, WHOLE_STEPS = (0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.0, 0.0), 6


def _minus(a: Vector, b: Vector) -> Vector:
    return tuple(c - d for c, d in zip(a, b, strict=True))


def _first_of_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The row of least hash in each cell and slot, of those in a batch."""
    for batch in batches:
        yield batch.sort_values(["hash", "point_id"]).drop_duplicates(["cx", "cy", "cz", "slot"])


def cylinder_hypotheses(points: DataFrame, size: float, axis: str, r_min: float, r_max: float, seed: int) -> DataFrame:
    """cx, cy, cz (a cell), h, a place on the axis (px, py, pz), its direction (ax, ay, az) and r for up to DRAWS pairs of a cell.

    The axis of two points is at right angles to both normals (`any`) or upright (`vertical`); it passes where the lines along their
    normals, seen in its direction, meet. points: point_id, x, y, z, nx, ny, nz.
    """
    at = F.struct(*AXES, *NORMAL)
    slot = F.pmod(F.xxhash64("point_id", F.lit(seed)), F.lit(2 * DRAWS)).alias("slot")
    ranked = points.select("point_id", *AXES, *NORMAL, *_cells(size), slot, F.xxhash64("point_id", F.lit(seed), F.lit(1)).alias("hash"))
    first = ranked.mapInPandas(_first_of_slots, ranked.schema)  # Spark sorts what min_by takes: few rows of a crowded cell are left for it
    drawn = first.groupBy("cx", "cy", "cz", "slot").agg(F.min_by(at, F.struct("hash", "point_id")).alias("p"))
    pairs = drawn.groupBy("cx", "cy", "cz", F.floor(F.col("slot") / 2).cast("int").alias("h")).agg(
        F.max(F.when(F.col("slot") % 2 == 0, F.col("p"))).alias("p"), F.max(F.when(F.col("slot") % 2 == 1, F.col("p"))).alias("q")
    )
    pairs = pairs.where("p IS NOT NULL AND q IS NOT NULL").select("cx", "cy", "cz", "h", *[F.col(f"{e}.{c}").alias(e + c) for e in "pq" for c in (*AXES, *NORMAL)])

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p, n, q, m = (batch[[e + c for c in names]].to_numpy(np.float64) for e in "pq" for names in (AXES, NORMAL))
            along = np.cross(n, m) if axis == "any" else np.tile([0.0, 0.0, 1.0], (len(p), 1))
            length = np.linalg.norm(along, axis=1)
            along = along / np.maximum(length, 1e-12)[:, None]
            n, m = (v - (v * along).sum(1)[:, None] * along for v in (n, m))
            nn, mm, nm, d = (n * n).sum(1), (m * m).sum(1), (n * m).sum(1), q - p
            bottom = nn * mm - nm * nm
            good = (length > 0.2) & (bottom > 1e-6)
            s = ((d * n).sum(1) * mm - (d * m).sum(1) * nm) / np.where(good, bottom, 1)
            place = p + s[:, None] * n
            r1, r2 = (np.linalg.norm(np.cross(e - place, along), axis=1) for e in (p, q))
            r = (r1 + r2) / 2
            good &= (r >= r_min) & (r <= r_max) & (np.abs(r1 - r2) <= 0.3 * r)
            found = pd.DataFrame(np.column_stack([place, along, r]), columns=["px", "py", "pz", "ax", "ay", "az", "r"])
            yield pd.concat([batch[["cx", "cy", "cz", "h"]].reset_index(drop=True), found], axis=1)[good]

    return pairs.mapInPandas(met, "cx long, cy long, cz long, h int, px double, py double, pz double, ax double, ay double, az double, r double")


def _fields_of(*names: str) -> Vector:
    return tuple(F.col(n) for n in names)


def _across(v: Vector, a: Vector) -> Column:
    """Distance of v from a line through the origin along a unit vector."""
    along = dot(v, a)
    return F.sqrt(F.greatest(F.lit(0.0), dot(v, v) - along * along))


def _cells(size: float) -> list[Column]:
    return [cell_of(c, size).alias(f"c{c}") for c in AXES]


HYPOTHESIS = ("px", "py", "pz", "ax", "ay", "az", "r")


def _scored(limit: float):
    """Rows of points (x, y, z, nx, ny, nz, cx, cy, cz) with the hypotheses of their cell (h, px, ... as lists) to rows of cells and
    hypotheses: points that agree and the sum of their errors in millionths. All pairs of a batch are held as columns."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            many = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            sizes = batch.column("h").value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            h, (px, py, pz, ax, ay, az, r) = many("h"), (many(c) for c in HYPOTHESIS)
            dx, dy, dz = one("x")[row] - px, one("y")[row] - py, one("z")[row] - pz
            along = dx * ax + dy * ay + dz * az
            off = np.abs(np.sqrt(np.maximum(dx * dx + dy * dy + dz * dz - along * along, 0.0)) - r)
            loose = np.maximum(2 * limit, SHARES[2] * r)
            agrees = (off < loose) & (np.abs(one("nx")[row] * ax + one("ny")[row] * ay + one("nz")[row] * az) < 0.4)
            on = np.flatnonzero(agrees)
            cell = pd.DataFrame({c: one(c) for c in ("cx", "cy", "cz")}).groupby(["cx", "cy", "cz"], sort=False).ngroup().to_numpy()
            _, first, which = np.unique(cell[row[on]] * DRAWS + h[on], return_index=True, return_inverse=True)
            # sums of whole millionths, so that their order doesn't matter
            error = np.bincount(which, np.floor(off[on] / loose[on] * 1e6 + 0.5), len(first)).astype(np.int64)
            at = on[first]
            facts = [a[at] for a in (px, py, pz, ax, ay, az, r)]
            columns = [one(c)[row[at]] for c in ("cx", "cy", "cz")] + [h[at], np.bincount(which, minlength=len(first)).astype(np.int64), error, *facts]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cx", "cy", "cz", "h", "n", "e", *HYPOTHESIS])

    return scored


def _best_of_cells(points: DataFrame, hypotheses: DataFrame, limit: float, size: float, least: int) -> list:
    """The hypothesis on which most points of its own cell agree, for the REFINED cells with most."""
    lists = hypotheses.groupBy("cx", "cy", "cz").agg(F.collect_list(F.struct("h", *HYPOTHESIS)).alias("l"))
    lists = lists.select("cx", "cy", "cz", *[F.col(f"l.{c}").alias(c) for c in ("h", *HYPOTHESIS)])  # DRAWS of a cell at most
    rows = points.select(*AXES, *NORMAL, *_cells(size)).join(lists, ["cx", "cy", "cz"])
    kind = f"cx long, cy long, cz long, h int, n long, e long, {', '.join(f'{c} double' for c in HYPOTHESIS)}"
    parts = rows.mapInArrow(_scored(limit), kind)
    facts = list(HYPOTHESIS)
    scores = parts.groupBy("cx", "cy", "cz", "h").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), *[F.first(c).alias(c) for c in facts])
    best = scores.where(F.col("n") >= least).groupBy("cx", "cy", "cz").agg(F.max_by(F.struct("n", *facts), F.struct("n", -F.col("e"), "h")).alias("s"))
    return best.select("cx", "cy", "cz", "s.*").orderBy(F.desc("n"), "cx", "cy", "cz").limit(REFINED).collect()


class Bundle:
    """Up to REFINED cylinders as arrays: a place on each axis, its direction, radius, and the stretch of it that counts."""

    def __init__(self, place: np.ndarray, along: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.place, self.along, self.r, self.low, self.high = place, along, r, low, high

    def taken(self, keep: np.ndarray) -> Bundle:
        return Bundle(self.place[keep], self.along[keep], self.r[keep], self.low[keep], self.high[keep])

    def bases(self) -> tuple[np.ndarray, np.ndarray]:
        """Two unit vectors across each axis and each other."""
        other = np.where(np.abs(self.along[:, 2:3]) < 0.9, [[0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0]])
        u = np.cross(self.along, other)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        return u, np.cross(self.along, u)

    def offsets(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place along each axis and distance from each surface, (rows, cylinders)."""
        t = p @ self.along.T - (self.place * self.along).sum(1)
        q2 = (p * p).sum(1)[:, None] - 2 * p @ self.place.T + (self.place * self.place).sum(1)
        return t, np.sqrt(np.maximum(q2 - t * t, 0)) - self.r

    def balls(self, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Factors of (1, x, y, z, x2 + y2 + z2) whose sum is positive outside the ball around all that may lie within the limits of a
        cylinder's stretch, and a share of these numbers that is more than rounding; None where a stretch has no end."""
        reach = np.maximum(np.abs(self.low), np.abs(self.high))
        if not np.isfinite(reach).all():
            return None
        own = (self.place * self.place).sum(1)
        return np.vstack([own - reach * reach - (self.r + limits) ** 2, -2 * self.place.T, np.ones(len(own))]), 1e-12 * (1 + own)

    def near(self, p: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each cylinder the rows within its limits and stretch, if any: steps from its place, places along its axis, distances.

        One product tells which rows lie in the ball around a stretch; only those are looked at further."""
        balls = self.balls(limits)
        inside = None
        if balls is not None:
            p2 = (p * p).sum(1)
            factors, slack = balls
            inside = (factors.T @ np.vstack([np.ones(len(p)), p.T, p2])) <= (slack + 1e-12 * p2.max(initial=0.0))[:, None]
        for k in range(len(self.r)):
            q = (p if inside is None else p[np.flatnonzero(inside[k])]) - self.place[k]
            if not len(q):
                continue
            t = q @ self.along[k]
            e = np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q) - t * t, 0)) - self.r[k]
            on = np.flatnonzero((np.abs(e) < limits[k]) & (t >= self.low[k]) & (t <= self.high[k]))
            if len(on):
                yield k, q[on], t[on], e[on]


def _normal_equations(points: DataFrame, found: Bundle, limit: float | np.ndarray) -> dict[int, np.ndarray]:
    """For each cylinder the sums of its points' weighted Jacobians (5 x 5), right sides (5), weights and squares, in one pass."""
    u, w = found.bases()
    limits = np.broadcast_to(limit, found.r.shape)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(found.r), 32))
        for batch in batches:
            p = batch[list(AXES)].to_numpy(np.float64)
            for k, q, tk, ek in found.near(p, limits):
                d = np.maximum(ek + found.r[k], 1e-12)
                ru, rw = (q @ u[k]) / d, (q @ w[k]) / d
                j = np.stack([-tk * ru, -tk * rw, -ru, -rw, np.full(len(tk), -1.0)])
                jw = j / np.sqrt(1 + (2 * ek / limits[k]) ** 2)
                total[k] += np.concatenate([(jw @ j.T).ravel(), jw @ ek, [len(tk), float(ek @ ek)]])
        kept = np.flatnonzero(total[:, 30])
        if len(kept):  # a column without any list has no type that Arrow knows
            yield pd.DataFrame({"k": kept.astype(np.int32), "s": list(total[kept])})

    parts = points.select(*AXES).mapInPandas(summed, "k int, s array<double>")
    sums = parts.select("k", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():  # at most REFINED x 32 numbers
        out.setdefault(r.k, np.zeros(32))[r.i] = r.v
    return out


def _stepped(found: Bundle, sums: dict[int, np.ndarray]) -> Bundle:
    """One step of least squares; upright axes turn too, so that tilts show."""
    u, w = found.bases()
    place, along, r = found.place.copy(), found.along.copy(), found.r.copy()
    for k, s in sums.items():
        a, b = s[:25].reshape(5, 5), s[25:30]
        scale = np.diag(a).copy()
        step = -np.linalg.solve(a + np.diag(1e-4 * scale + 1e-9), b)
        step[:2] = np.clip(step[:2], -0.2, 0.2)
        step[2:] = np.clip(step[2:], -0.5 * r[k], 0.5 * r[k])
        d = along[k] + step[0] * u[k] + step[1] * w[k]
        place[k] = place[k] + step[2] * u[k] + step[3] * w[k]
        along[k] = d / np.linalg.norm(d)
        r[k] = abs(r[k] + step[4])
    return Bundle(place, along, r, found.low, found.high)


def _assigned(points: DataFrame, found: Bundle, limit: float) -> DataFrame:
    """point_id, k, t and e of the points on a cylinder: the first in the order of the bundle where several would take one."""
    kind = points.schema["point_id"].dataType.simpleString()

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            t, e = found.offsets(batch[list(AXES)].to_numpy(np.float64))
            near = (np.abs(e) < limit) & (t >= found.low) & (t <= found.high)
            on = np.flatnonzero(near.any(1))
            k = near[on].argmax(1)
            yield pd.DataFrame({"point_id": batch["point_id"].to_numpy()[on], "k": k.astype(np.int32), "t": t[on, k], "e": e[on, k]})

    return points.select("point_id", *AXES).mapInPandas(chosen, f"point_id {kind}, k int, t double, e double")


def _runs(on: DataFrame, found: Bundle, limit: float) -> dict[int, tuple[int, float, float]]:
    """For each cylinder its longest run: points, begin and end. A run ends at a gap of more than 5 limits or a diameter.

    Points meet in bins no longer than such a gap, so a run is made of bins and its gaps lie between them.
    """
    gap = F.element_at(F.array(*[F.lit(float(max(5 * limit, 2 * r))) for r in found.r]), F.col("k") + 1)
    bins = on.groupBy("k", F.floor(F.col("t") / gap).alias("bin"), gap.alias("gap")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    order = Window.partitionBy("k").orderBy("bin")
    breaks = (F.col("t0") - F.lag("t1").over(order) > F.col("gap")).cast("int")
    runs = bins.withColumn("break", breaks).withColumn("run", F.sum(F.coalesce("break", F.lit(0))).over(order))
    runs = runs.groupBy("k", "run").agg(F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    best = runs.groupBy("k").agg(F.max_by(F.struct("n", "t0", "t1"), F.struct("n", -F.col("run"))).alias("b"))
    return {r.k: (r.b.n, r.b.t0, r.b.t1) for r in best.collect()}  # at most REFINED rows


FACTS = "cylinder int, points long, radius double, length double, ax double, ay double, az double, bx double, by double, bz double, tx double, ty double, tz double, tilt double, rms double"


def detect_cylinders(
    points: DataFrame, limit: float = 0.03, r_min: float = 0.05, r_max: float = 5.0, min_points: int = 150, max_count: int = 20,
    axis: str = "vertical", max_tilt: float = 10.0, k: int = 16, size: float | None = None, seed: int = 0, normals: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Facts of the cylinders, those with most points first within a round (cylinder, points, radius, length, axis ax, ay, az, base bx,
    by, bz, top tx, ty, tz, tilt in degrees, rms), and the points of each (point_id, cylinder).

    axis: `vertical` looks at points with a flat normal only and takes tilts up to max_tilt; `any` takes every direction. Points within
    the limit of a surface in one run along its axis are the cylinder's, if they are min_points or more. size: of the cells that
    hypotheses are drawn in, twice r_max by default. normals: point_id, nx, ny, nz, or points itself if it holds them, which saves a
    join; without it they are those of local planes of k points. Points without finite coordinates take no part; an empty cloud has no cylinders; of repeated points all are counted.
    Search ends with max_count cylinders (the number asked for), or after two rounds in a row without one.
    """
    if axis not in ("vertical", "any"):
        raise ValueError(f"axis is vertical or any, not {axis}")
    spark = points.sparkSession
    kind = points.schema["point_id"].dataType.simpleString()
    size = size or 2 * r_max
    own = normals is points and list(NORMAL) or []
    held = placed(saved(points.select("point_id", *AXES, *own)), AXES)
    middle = held.agg(*[F.round((F.min(c) + F.max(c)) / 2).alias(c) for c in AXES]).first()
    centre = np.array([middle[c] or 0.0 for c in AXES])
    held = held.select("point_id", *[(F.col(c) - float(centre[i])).alias(c) for i, c in enumerate(AXES)], *own)
    if normals is None:
        start = max(r_min, limit)
        normals = local_planes(held, k, start) if held.limit(k + 1).count() > k else None
    facts: list[tuple] = []
    members = None
    if normals is None:
        return spark.createDataFrame(facts, FACTS), spark.createDataFrame([], f"point_id {kind}, cylinder int")
    pool = held if own else held.join(normals.select("point_id", *NORMAL), "point_id")
    if axis == "vertical":
        pool = pool.where(F.abs("nz") < 0.5)
    pool = saved(pool)
    turn = fails = 0
    while len(facts) < max_count and fails < 2:
        turn += 1
        best = _best_of_cells(pool, cylinder_hypotheses(pool, size, axis, r_min, r_max, seed + turn), limit, size, max(5, min_points // 16))
        if not best:
            fails += 1
            continue
        along = np.array([[b.ax, b.ay, b.az] for b in best])
        inside = (np.array([[b.cx, b.cy, b.cz] for b in best]) + 0.5) * size
        place = np.array([[b.px, b.py, b.pz] for b in best])
        place = place + ((inside - place) * along).sum(1)[:, None] * along  # the place on the axis that is nearest to the cell's middle
        reach = np.full(len(best), 1.5 * size)
        found = Bundle(place, along, np.array([b.r for b in best]), -reach, reach)
        for share in SHARES:
            found = _stepped(found, _normal_equations(pool, found, np.maximum(2 * limit, share * found.r)))
        found = Bundle(found.place, found.along, found.r, np.full(len(best), -np.inf), np.full(len(best), np.inf))
        sums = _normal_equations(pool, found, limit)
        order = sorted((k for k in sums if r_min <= found.r[k] <= r_max and sums[k][30] >= min_points), key=lambda k: (-sums[k][30], k))
        if not order:
            fails += 1
            continue
        found = found.taken(np.array(order))
        runs = _runs(_assigned(pool, found, limit), found, limit)
        kept = [k for k in sorted(runs) if runs[k][0] >= min_points // 2]  # a run may grow once its axis is better known
        if not kept:
            fails += 1
            continue
        found = found.taken(np.array(kept))
        t0, t1 = (np.array([runs[k][i] for k in kept]) for i in (1, 2))
        found.place = found.place + ((t0 + t1) / 2)[:, None] * found.along
        half = (t1 - t0) / 2 + max(5 * limit, 1e-6)
        found.low, found.high = -half, half
        for _ in range(WHOLE_STEPS):
            found = _stepped(found, _normal_equations(pool, found, 1.5 * limit))
        found.low, found.high = np.full(len(kept), -np.inf), np.full(len(kept), np.inf)
        on = saved(_assigned(pool, found, limit))
        runs = _runs(on, found, limit)
        accepted = []
        for j in sorted(runs, key=lambda j: (-runs[j][0], j)):
            n, t0, t1 = runs[j]
            a = found.along[j] * next((np.sign(v) for v in found.along[j][[2, 0, 1]] if abs(v) > 1e-6), 1)
            tilt = math.degrees(math.acos(min(1.0, abs(float(a[2])))))
            if n < min_points or not r_min <= found.r[j] <= r_max or axis == "vertical" and tilt > max_tilt or len(facts) + len(accepted) >= max_count:
                continue
            ends = sorted((found.place[j] + centre + found.along[j] * t for t in (t0, t1)), key=lambda p: float(p @ a))
            accepted.append((j, t0, t1, len(facts) + len(accepted), n, float(found.r[j]), t1 - t0, a, *ends, tilt))
        if not accepted:
            fails += 1
            continue
        fails = 0
        names = spark.createDataFrame([(int(r[0]), float(r[1]), float(r[2]), r[3]) for r in accepted], "k int, t0 double, t1 double, cylinder int")
        mine = saved(on.join(F.broadcast(names), "k").where("t BETWEEN t0 AND t1").select("point_id", "cylinder", "e"))  # a row for each accepted cylinder
        rms = {r.cylinder: r.rms for r in mine.groupBy("cylinder").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms")).collect()}
        for _, _, _, name, n, r, length, a, base, top, tilt in accepted:
            facts.append((name, n, r, float(length), *map(float, a), *map(float, base), *map(float, top), tilt, rms[name]))
        more = mine.select("point_id", "cylinder")
        members = more if members is None else members.unionByName(more)
        if len(facts) < max_count:
            pool = saved(pool.join(more.select("point_id").distinct(), "point_id", "left_anti"))
    return spark.createDataFrame(facts, FACTS), members if members is not None else spark.createDataFrame([], f"point_id {kind}, cylinder int")


def cylinder_meshes(facts: DataFrame, sides: int = 40) -> tuple[DataFrame, DataFrame]:
    """Closed meshes of cylinders (vertices: mesh_id, vid, x, y, z; faces: mesh_id, fid, a, b, c). vid goes from 0: the ring of the base,
    that of the top, and the middles of both."""
    a = _fields_of("ax", "ay", "az")
    other = tuple(F.when(F.abs("az") < 0.9, F.lit(float(i == 2))).otherwise(F.lit(float(i == 0))) for i in range(3))
    u = cross(a, other)
    length = F.sqrt(dot(u, u))
    rows = facts.withColumns({f"u{c}": e / length for c, e in zip(AXES, u, strict=True)})
    w = cross(a, _fields_of("ux", "uy", "uz"))
    rows = rows.withColumns({f"w{c}": e for c, e in zip(AXES, w, strict=True)}).withColumn("vid", F.explode(F.sequence(F.lit(0), F.lit(2 * sides + 1))))
    v = F.col("vid")
    top = (v >= sides) & (v < 2 * sides) | (v == 2 * sides + 1)
    angle = F.when(v < 2 * sides, v % sides * (2 * math.pi / sides))
    spread = lambda c: F.coalesce(F.col("radius") * (F.cos(angle) * F.col(f"u{c}") + F.sin(angle) * F.col(f"w{c}")), F.lit(0.0))
    end = lambda c: F.when(top, F.col(f"t{c}")).otherwise(F.col(f"b{c}"))
    vertices = rows.select(F.col("cylinder").alias("mesh_id"), "vid", *[(end(c) + spread(c)).alias(c) for c in AXES])
    side = F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("i")
    i, j = F.col("i"), (F.col("i") + 1) % sides
    three = lambda p, q, r: F.struct(p.cast("int").alias("a"), q.cast("int").alias("b"), r.cast("int").alias("c"))
    parts = F.array(three(i, j, j + sides), three(i, j + sides, i + sides), three(j, i, F.lit(2 * sides)), three(i + sides, j + sides, F.lit(2 * sides + 1)))
    faces = facts.select(F.col("cylinder").alias("mesh_id"), side).select("mesh_id", (4 * i).alias("fid"), F.posexplode(parts).alias("part", "f")).select("mesh_id", (F.col("fid") + F.col("part")).alias("fid"), "f.*")
    return vertices, faces
