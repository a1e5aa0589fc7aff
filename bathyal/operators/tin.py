"""Delaunay triangulation of points that no single task could hold, and sections through triangles.

Points are dealt to the cells of a quadtree (four by four children), each to the coarsest cell with at most LEAF_POINTS of
them. From the finest level to the root, one group per cell triangulates what isn't finished yet. A triangle whose
circumcircle lies within the cell is final, for points elsewhere can't lie in it. Only vertices of other triangles and of the
hull go on to the next level, together with the edges that separate final triangles from the rest (`walls`): every triangle
that is still to be found is a Delaunay triangle of the vertices that go on, and those on the final side of a wall are known
already. So a level holds about as many points as lie near the borders of its cells.

Points that come to a cell for the first time are met by `stars` before: the triangles around each of them are sought among the
points nearby, for thousands of points at a time. Only what that leaves open, near borders and gaps, is triangulated one by one.

Points that lie on one line or on one circle have no unique triangulation. All coordinates are moved by a fixed hash of the
point's id, by at most JITTER of the extent, so that all cells agree; slivers of no height that this leaves along straight
hulls are dropped. Points with equal x and y count once (the smallest id); points without finite coordinates take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bathyal.operators.graph import saved

LEAF_POINTS = 60_000
#: Levels below the root; a cell has four by four children.
LEVELS = 8
JITTER = 1e-13
#: Triangles whose height is less than this share of their longest edge are slivers.
SLIVER = 1e-9
#: Points in a bucket of `stars` on average, most points around one that are looked at, and corners of a star that are sought.
NEAR, AROUND, SIDES = 1, 160, 24
#: Numbers that `stars` holds in one array.
BLOCK = 1 << 17


def _halves(x: list[float], y: list[float]) -> tuple[list[int], list[int], list[int]]:
    """Delaunay edges of points sorted by x, then y, two or more: origin, next edge counter-clockwise about the origin, and the
    one before, for half-edges e and their twins e ^ 1. Divide and conquer after Guibas and Stolfi."""
    org: list[int] = []
    ahead: list[int] = []
    back: list[int] = []

    def edge(a: int, b: int) -> int:
        e = len(org)
        org.extend((a, b))
        ahead.extend((e, e + 1))
        back.extend((e, e + 1))
        return e

    def splice(a: int, b: int) -> None:
        p, q = ahead[a], ahead[b]
        ahead[a], ahead[b] = q, p
        back[q], back[p] = a, b

    def connect(a: int, b: int) -> int:
        e = edge(org[a ^ 1], org[b])
        splice(e, back[a ^ 1])
        splice(e ^ 1, b)
        return e

    def remove(e: int) -> None:
        splice(e, back[e])
        splice(e ^ 1, back[e ^ 1])
        org[e] = org[e ^ 1] = -1

    def turn(a: int, b: int, c: int) -> float:
        return (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])

    def within(a: int, b: int, c: int, d: int) -> bool:
        ax, ay, bx, by, cx, cy = x[a] - x[d], y[a] - y[d], x[b] - x[d], y[b] - y[d], x[c] - x[d], y[c] - y[d]
        p, q, r = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return ax * (by * r - q * cy) - ay * (bx * r - q * cx) + p * (bx * cy - by * cx) > 0

    def halved(lo: int, hi: int) -> tuple[int, int]:
        """The hull's edge from the leftmost point, counter-clockwise, and the one from the rightmost point, clockwise."""
        if hi - lo == 2:
            e = edge(lo, lo + 1)
            return e, e ^ 1
        if hi - lo == 3:
            a, b = edge(lo, lo + 1), edge(lo + 1, lo + 2)
            splice(a ^ 1, b)
            side = turn(lo, lo + 1, lo + 2)
            if side == 0:
                return a, b ^ 1
            c = connect(b, a)
            return (a, b ^ 1) if side > 0 else (c ^ 1, c)
        mid = (lo + hi) // 2
        left_out, left_in = halved(lo, mid)
        right_in, right_out = halved(mid, hi)
        while True:  # the lower common tangent
            if turn(org[right_in], org[left_in], org[left_in ^ 1]) > 0:
                left_in = back[left_in ^ 1]
            elif turn(org[left_in], org[right_in ^ 1], org[right_in]) > 0:
                right_in = ahead[right_in ^ 1]
            else:
                break
        base = connect(right_in ^ 1, left_in)
        if org[left_in] == org[left_out]:
            left_out = base ^ 1
        if org[right_in] == org[right_out]:
            right_out = base
        while True:
            right, left = org[base], org[base ^ 1]
            a = ahead[base ^ 1]
            rises = turn(left, right, org[a ^ 1]) > 0
            if rises:
                while turn(left, right, org[(n := ahead[a]) ^ 1]) > 0 and within(left, right, org[a ^ 1], org[n ^ 1]):
                    remove(a)
                    a = n
            b = back[base]
            falls = turn(left, right, org[b ^ 1]) > 0
            if falls:
                while turn(left, right, org[(n := back[b]) ^ 1]) > 0 and within(left, right, org[b ^ 1], org[n ^ 1]):
                    remove(b)
                    b = n
            if not rises and not falls:
                return left_out, right_out
            if not rises or falls and within(org[a ^ 1], left, right, org[b ^ 1]):
                base = connect(b, base ^ 1)
            else:
                base = connect(base ^ 1, a ^ 1)

    if len(x) > 1:
        halved(0, len(x))
    return org, ahead, back


def delaunay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the Delaunay triangles, counter-clockwise, of points no two of which are equal, as an array of three columns."""
    order = np.lexsort((y, x))
    org, _, back = (np.array(v, np.int64) for v in _halves(x[order].tolist(), y[order].tolist()))
    if len(org) < 6:
        return np.zeros((0, 3), np.int64)
    e = np.flatnonzero(org >= 0)
    second = back[e ^ 1]  # the next edge of the face on the left
    third = back[second ^ 1]
    face = (back[third ^ 1] == e) & (e < second) & (e < third)
    corners = np.stack([org[e], org[second], org[third]], 1)[face]
    px, py = x[order][corners], y[order][corners]
    up = (px[:, 1] - px[:, 0]) * (py[:, 2] - py[:, 0]) - (py[:, 1] - py[:, 0]) * (px[:, 2] - px[:, 0]) > 0
    return order[corners[up]]


def circles(x: np.ndarray, y: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre and radius of the circumcircles."""
    (ax, bx, cx), (ay, by, cy) = x[corners].T, y[corners].T
    bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
    d = 2 * (bx * cy - by * cx)
    with np.errstate(divide="ignore", invalid="ignore"):
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return ax + ux, ay + uy, np.hypot(ux, uy)


def stars(x: np.ndarray, y: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Corners, counter-clockwise, of Delaunay triangles that the points' surroundings tell: most of them where points lie evenly,
    none in doubt. box: x1, y1, x2, y2; no other point lies in it.

    Points lie in buckets of a few. Around each point, from its nearest, the next corner is the one that sees the last side under
    the largest angle, of all in the five by five buckets about. A triangle counts if all three corners find it, if its circle lies in
    the box and in the buckets about one of them, and if no other comes as near to its circle as rounding.
    """
    n, none = len(x), np.zeros((0, 3), np.int64)
    if not 32 <= n < 1 << 20:
        return none
    x1, y1 = x.min(), y.min()
    wide, high = x.max() - x1, y.max() - y1
    side = max(math.sqrt(wide * high * NEAR / n), max(wide, high) * 2 / n)
    if not 0 < side < math.inf:
        return none
    bx, by = np.floor((x - x1) / side).astype(np.int64), np.floor((y - y1) / side).astype(np.int64)
    across, up = int(bx.max()) + 1, int(by.max()) + 1
    order = np.argsort(by * across + bx, kind="stable")
    xs, ys, bx, by = x[order], y[order], bx[order], by[order]
    begins = np.concatenate([[0], np.cumsum(np.bincount(by * across + bx, minlength=across * up))])
    first, sizes = [], []
    for row in (by - 2, by - 1, by, by + 1, by + 2):
        held = np.clip(row, 0, up - 1) * across
        a, b = begins[held + np.maximum(bx - 2, 0)], begins[held + np.minimum(bx + 2, across - 1) + 1]
        first.append(a)
        sizes.append(np.where((row >= 0) & (row < up), b - a, 0))
    ends = np.cumsum(sizes, axis=0)
    asked = np.flatnonzero(ends[-1] <= AROUND)
    found = []
    step = BLOCK // AROUND
    for lo in range(0, len(asked), step):
        own = asked[lo : lo + step]
        place = np.arange(int(ends[-1][own].max()))
        ids = np.broadcast_to(own[:, None], (len(own), len(place))).copy()  # a point itself fills up its row
        before = 0
        for k in range(5):
            end = ends[k][own]
            on = (place >= np.broadcast_to(before, end.shape)[:, None]) & (place < end[:, None])
            ids[on] = (place + (first[k][own] - before)[:, None])[on]
            before = end
        px, py = xs[own], ys[own]
        rx, ry = xs[ids] - px[:, None], ys[ids] - py[:, None]
        rr = rx * rx + ry * ry
        q = np.where(rr > 0, rr, np.inf).argmin(1)
        start, line = ids[np.arange(len(own)), q], np.arange(len(own))
        left, right = np.maximum(x1 + (bx[own] - 2) * side, box[0]), np.minimum(x1 + (bx[own] + 3) * side, box[2])
        low, top = np.maximum(y1 + (by[own] - 2) * side, box[1]), np.minimum(y1 + (by[own] + 3) * side, box[3])
        left, right, low, top = (np.where(g, v, e) for v, e, g in ((left, box[0], bx[own] >= 2), (right, box[2], bx[own] < across - 2), (low, box[1], by[own] >= 2), (top, box[3], by[own] < up - 2)))
        for _ in range(SIDES):
            at = np.arange(len(line))
            qx, qy = rx[at, q], ry[at, q]
            turn = qx[:, None] * ry - qy[:, None] * rx
            with np.errstate(divide="ignore", invalid="ignore"):
                cot = np.where(turn > 0, (rr - qx[:, None] * rx - qy[:, None] * ry) / turn, np.inf)
            r = cot.argmin(1)
            best = cot[at, r]
            cot[at, r] = np.inf
            some = best < np.inf
            with np.errstate(divide="ignore", invalid="ignore"):
                doubt = 64 * np.finfo(float).eps * (1 + np.abs(best)) * (rr[at, r] + np.sqrt(rr[at, r] * rr[at, q])) / turn[at, r]
                clear = cot.min(1) - best > doubt
                mx, my = (qx - qy * best) / 2, (qy + qx * best) / 2
                reach = np.hypot(mx, my) * (1 + 1e-9)
                mx, my = mx + px[line], my + py[line]
                held = clear & (mx - reach > left[line]) & (mx + reach < right[line]) & (my - reach > low[line]) & (my + reach < top[line])
            p, c, d = own[line], ids[at, q], ids[at, r]
            found.append(np.stack([p, c, d, held, clear], 1)[some])
            on = some & (d != start[line])
            if not on.any():
                break
            line, q = line[on], r[on]
            rx, ry, rr, ids = rx[on], ry[on], rr[on], ids[on]
    if not found:
        return none
    rows = np.concatenate(found)
    corners = rows[:, :3]
    turned = np.take_along_axis(corners, (corners.argmin(1)[:, None] + np.arange(3)) % 3, 1)
    key, which, times = np.unique((turned[:, 0] * n + turned[:, 1]) * n + turned[:, 2], return_inverse=True, return_counts=True)
    good = (times == 3) & (np.bincount(which, rows[:, 3], len(key)) > 0) & (np.bincount(which, rows[:, 4], len(key)) == 3)
    key = key[good]
    corners = np.stack([key // (n * n), key // n % n, key % n], 1)
    sides = corners * n + np.roll(corners, -1, 1)
    _, which, times = np.unique(sides.ravel(), return_inverse=True, return_counts=True)
    return order[corners[(times[which].reshape(-1, 3) == 1).all(1)]]


def settle(x: np.ndarray, y: np.ndarray, walls: set[tuple[int, int]], box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Final triangles that weren't known, the places of points that go on and the walls between.

    walls: pairs of places; known triangles lie on the left of each. box: x1, y1, x2, y2; no other point lies in it.
    """
    if walls:
        return _settled(x, y, walls, box)
    final, n = stars(x, y, box), len(x)
    if not len(final):
        return _settled(x, y, walls, box)
    a, b = final.ravel(), np.roll(final, -1, 1).ravel()
    open_ = ~np.isin(b * n + a, a * n + b)
    on = np.ones(n, bool)
    on[a] = False
    on[a[open_]] = on[b[open_]] = True
    rest = np.flatnonzero(on)
    local = np.cumsum(on) - 1
    corners, left, between = _settled(x[rest], y[rest], set(zip(local[a[open_]].tolist(), local[b[open_]].tolist(), strict=True)), box)
    return np.concatenate([final, rest[corners]]), rest[left], [(int(rest[p]), int(rest[q])) for p, q in between]


def _settled(x: np.ndarray, y: np.ndarray, walls: set[tuple[int, int]], box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """What `settle` gives, by the triangulation of all points."""
    corners = delaunay(x, y)
    n = len(corners)
    left = {}
    for k, (a, b, c) in enumerate(corners.tolist()):
        left[a, b] = left[b, c] = left[c, a] = k
    known = np.zeros(n, bool)
    todo = [left[w] for w in walls if w in left]
    while todo:
        k = todo.pop()
        if not known[k]:
            known[k] = True
            a, b, c = corners[k].tolist()
            todo += [left[q, p] for p, q in ((a, b), (b, c), (c, a)) if (p, q) not in walls and (q, p) not in walls and (q, p) in left]
    cx, cy, r = circles(x, y, corners)
    r = r * (1 + 1e-9)
    inner = (cx - r > box[0]) & (cy - r > box[1]) & (cx + r < box[2]) & (cy + r < box[3])
    if math.isinf(box[2]):
        inner[:] = True
    done = known | inner
    between = [(a, b) for (a, b), k in left.items() if done[k] and not ((other := left.get((b, a))) is not None and done[other])]
    on = np.zeros(len(x), bool)
    on[corners[~done].ravel()] = True
    hull = [v for pair in left if pair[::-1] not in left for v in pair]
    on[hull if n else slice(None)] = True
    return corners[inner & ~known], np.flatnonzero(on), between


#: Columns of a corner's place.
PLACES = [f"{k}{c}" for k in "abc" for c in "xyz"]
SHAPE = "kind string, a long, b long, c long, x double, y double, " + ", ".join(f"{c} double" for c in PLACES)


def _level(level: int, levels: int, size: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The step of one level: rows of SHAPE of a cell, points (kind "p": id a, moved x and y, place ax, ay, az) and walls ("w": a, b), to
    rows of final triangles ("t": a, b, c and their places), and points and walls that go on."""

    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cx, cy = key
        width = size * 4.0 ** (levels - level)
        box = (cx * width, cy * width, (cx + 1) * width, (cy + 1) * width) if level else (-math.inf, -math.inf, math.inf, math.inf)
        points = rows[rows["kind"] == "p"]
        ids, x, y = points["a"].to_numpy(), points["x"].to_numpy(), points["y"].to_numpy()
        place = points[["ax", "ay", "az"]].to_numpy()
        held = rows[rows["kind"] == "w"]
        walls = set()
        if len(held):
            at = {i: k for k, i in enumerate(ids.tolist())}
            walls = {(at[a], at[b]) for a, b in zip(held["a"].tolist(), held["b"].tolist(), strict=True)}
        corners, on, between = settle(x, y, walls, box)
        t = {"kind": "t"} | {k: ids[corners[:, i]] for i, k in enumerate("abc")} | {"x": 0.0, "y": 0.0}
        out = [pd.DataFrame(t | {f"{k}{c}": place[corners[:, i], j] for i, k in enumerate("abc") for j, c in enumerate("xyz")})]
        if level:
            blank = {c: math.nan for c in PLACES}
            out.append(pd.DataFrame({"kind": "p", "a": ids[on], "b": 0, "c": 0, "x": x[on], "y": y[on]} | blank | {f"a{c}": place[on, j] for j, c in enumerate("xyz")}))
            pairs = np.array(between, np.int64).reshape(-1, 2)
            out.append(pd.DataFrame({"kind": "w", "a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]], "c": 0, "x": x[pairs[:, 0]], "y": y[pairs[:, 0]]} | blank))
        return pd.concat([o for o in out if len(o)] or out[:1])

    return step


def triangles(points: DataFrame, leaf_points: int | None = None) -> DataFrame:
    """a, b, c: ids of the corners of all Delaunay triangles, counter-clockwise, and their places ax, ay, az, bx, ... points: point_id (a
    long), x, y, z. A z that is no number is null."""
    leaf_points = leaf_points or LEAF_POINTS
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
    single = points.where(finite("x") & finite("y")).select("point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    single = saved(single.groupBy("x", "y").agg(F.min(F.struct("point_id", "z")).alias("p")).select(F.col("p.point_id").alias("a"), "x", "y", "p.z"))
    box = single.agg(*[f(c).alias(f"{c}{k}") for c in "xy" for k, f in (("1", F.min), ("2", F.max))]).first()
    empty = points.sparkSession.createDataFrame([], ", ".join(["a long, b long, c long", *[f"{c} double" for c in PLACES]]))
    if box.x1 is None:
        return empty
    extent = max(box.x2 - box.x1, box.y2 - box.y1)
    if extent == 0:
        return empty
    size = extent * (1 + 1e-6) / 4**LEVELS
    nudge = lambda c, seed: F.col(c) - float(box[f"{c}1"]) + F.pmod(F.xxhash64("a", F.lit(seed)), F.lit(1 << 20)) * (JITTER * extent / (1 << 20))
    shift = lambda c, k: F.expr(f"shiftright({c}, cast(2 * ({LEVELS} - {k}) as int))")
    none = F.lit(None).cast("double")
    begun = single.select("a", nudge("x", 1).alias("x"), nudge("y", 2).alias("y"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    begun = begun.withColumns({f"f{c}": F.floor(F.col(c) / size).cast("long") for c in "xy"})
    cells = begun.groupBy("fx", "fy").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    # at most a cell for each leaf_points points and level
    full = saved(cells.groupBy("level", shift("fx", "level").alias("cx"), shift("fy", "level").alias("cy")).agg(F.sum("n").alias("n")).where(F.col("n") > leaf_points))
    start = F.lit(0)
    deepest = max((r[0] + 1 for r in full.select("level").distinct().collect()), default=0)
    for level in range(deepest):  # a cell within a full one is on the next level
        held = full.where(F.col("level") == level).select((F.col("cx") * 4**LEVELS + F.col("cy")).alias("cell"), F.lit(1).alias(f"full{level}"))
        begun = begun.withColumn("cell", shift("fx", level) * 4**LEVELS + shift("fy", level)).join(held, "cell", "left").drop("cell")
        start = start + F.coalesce(f"full{level}", F.lit(0))
    begun = saved(begun.select("a", "x", "y", "ax", "ay", "az", start.alias("start")))
    rows, found = None, None
    for level in range(deepest, -1, -1):
        zero = F.lit(0).cast("long")
        new = begun.where(F.col("start") == level).select(F.lit("p").alias("kind"), "a", zero.alias("b"), zero.alias("c"), "x", "y", "ax", "ay", "az", *[none.alias(c) for c in PLACES[3:]])
        rows = new if rows is None else rows.unionByName(new)
        cell = [shift(f"floor({c} / {size!r})", level).alias(f"c{c}") for c in "xy"]
        done = saved(rows.groupBy(*cell).applyInPandas(_level(level, LEVELS, size), SHAPE))
        more = done.where("kind = 't'").select("a", "b", "c", *PLACES)
        found = more if found is None else found.unionByName(more)
        rows = done.where("kind <> 't'")
    return found


def placed_faces(points: DataFrame, max_edge: float = 0.0, leaf_points: int | None = None) -> DataFrame:
    """The faces of `build_tin` with the places of their corners: mesh_id, fid, a, b, c, ax, ay, az, bx, ..."""
    square = lambda p, q: (F.col(f"{p}x") - F.col(f"{q}x")) ** 2 + (F.col(f"{p}y") - F.col(f"{q}y")) ** 2
    longest = F.greatest(square("a", "b"), square("b", "c"), square("c", "a"))
    cross = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    kept = triangles(points, leaf_points).where(cross > SLIVER * longest)
    if max_edge > 0:
        kept = kept.where(longest <= max_edge * max_edge)
    corner = {k: F.struct(F.col(k).alias("v"), *[F.col(f"{k}{c}").alias(c) for c in "xyz"]) for k in "abc"}
    order = lambda *names: F.array(*[corner[k] for k in names])
    turned = F.when((F.col("a") < F.col("b")) & (F.col("a") < F.col("c")), order(*"abc")).when(F.col("b") < F.col("c"), order(*"bca")).otherwise(order(*"cab"))
    t = kept.select(turned.alias("t")).select(*[F.col("t")[i].alias(k) for i, k in enumerate(("p", "q", "r"))])
    ids = [F.col(f"{p}.v").alias(k) for p, k in zip("pqr", "abc", strict=True)]
    places = [F.col(f"{p}.{c}").alias(f"{k}{c}") for p, k in zip("pqr", "abc", strict=True) for c in "xyz"]
    return t.select(F.lit(0).alias("mesh_id"), F.xxhash64(F.array("p.v", "q.v", "r.v")).alias("fid"), *ids, *places)


def build_tin(points: DataFrame, max_edge: float = 0.0, leaf_points: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A mesh (vertices and faces) of the Delaunay triangles without an edge over max_edge (0: no limit); each face counter-clockwise
    from its smallest vertex. vertices: mesh_id, vid (the point's id), x, y, z; faces: mesh_id, fid, a, b, c."""
    vertices = points.select(F.lit(0).alias("mesh_id"), F.col("point_id").alias("vid"), "x", "y", "z")
    return vertices, placed_faces(points, max_edge, leaf_points).select("mesh_id", "fid", "a", "b", "c")


def delaunay_faults(vertices: DataFrame, faces: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Edges of a mesh (mesh_id, lo, hi) whose two faces aren't a Delaunay pair: the corner of one lies in the other's circumcircle
    by more than a share of it. A triangulation without such an edge is Delaunay as a whole."""
    from bathyal.operators.mesh import corners

    placed = corners(faces, vertices)
    point = lambda k: F.struct(F.col(k).alias("v"), F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y"))
    side = lambda p, q, r: F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"), F.struct(point(p).alias("p"), point(q).alias("q"), point(r).alias("r")).alias("t"))
    sides = placed.select("mesh_id", "fid", F.explode(F.array(side("a", "b", "c"), side("b", "c", "a"), side("c", "a", "b"))).alias("s")).select("mesh_id", "fid", "s.*")
    pairs = sides.groupBy("mesh_id", "lo", "hi").agg(F.min_by("t", "fid").alias("t"), F.max_by("t", "fid").alias("u"), F.count(F.lit(1)).alias("n")).where("n = 2")
    rel = {f"{n}{c}": F.col(f"t.{n}.{c}") - F.col(f"u.r.{c}") for n in "pqr" for c in "xy"}
    pairs = pairs.withColumns(rel)
    norm = lambda n: F.col(f"{n}x") * F.col(f"{n}x") + F.col(f"{n}y") * F.col(f"{n}y")
    cross = lambda m, n: F.col(f"{m}x") * F.col(f"{n}y") - F.col(f"{n}x") * F.col(f"{m}y")
    det = norm("p") * cross("q", "r") - norm("q") * cross("p", "r") + norm("r") * cross("p", "q")
    most = F.greatest(norm("p"), norm("q"), norm("r"))
    return pairs.where(det > tolerance * most * most).select("mesh_id", "lo", "hi")


#: Sizes of buckets are this times a power of two.
BUCKET_STEPS = 20


def _buckets(box: list[str], size: float, level: str) -> list[Column]:
    """Numbers of the buckets of a level that a box (x1, y1, x2, y2) touches, along x and along y."""
    width = F.pow(F.lit(2.0), F.col(level)) * size
    return [F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)) for a, b in ((box[0], box[2]), (box[1], box[3]))]


def tin_section(vertices: DataFrame, faces: DataFrame, lines: DataFrame, size: float) -> DataFrame:
    """line_id, seq, fid, ch0, z0, ch1, z1, joined: the stretch of each segment that lies in each triangle, with heights at both ends,
    and whether another stretch ends where it begins. In order of ch0 these are the section; it has a gap before each that isn't joined.

    lines: line_id, seq, x, y (in order of seq, any number of vertices). size: of the least bucket, about the length of an edge.
    Triangles lie in buckets of about their own size, and pieces of segments, no longer than a bucket, meet them at each size
    there is. Where a line follows an edge, the stretch counts once, for the face of smaller fid.
    """
    from bathyal.operators.mesh import corners

    order = Window.partitionBy("line_id").orderBy("seq")
    legs = lines.select("line_id", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(order).alias("x1"), F.lead("y").over(order).alias("y1"))
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    legs = legs.withColumn("length", F.coalesce(length, F.lit(0.0))).withColumn("cum", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    legs = saved(legs.withColumn("cum", F.coalesce("cum", F.lit(0.0))).where("length > 0"))
    x, y = [F.col(f"{k}x") for k in "abc"], [F.col(f"{k}y") for k in "abc"]
    t = corners(faces, vertices).withColumns({"tx1": F.least(*x), "ty1": F.least(*y), "tx2": F.greatest(*x), "ty2": F.greatest(*y)})
    wide = F.greatest(F.col("tx2") - F.col("tx1"), F.col("ty2") - F.col("ty1"), F.lit(1e-300))
    t = saved(t.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(BUCKET_STEPS), F.ceil(F.log2(wide / size)))).cast("int")))
    held = [r[0] for r in t.select("level").distinct().collect()]  # BUCKET_STEPS + 1 at most
    for name, numbers in zip(("ubx", "uby"), _buckets(["tx1", "ty1", "tx2", "ty2"], size, "level"), strict=True):
        t = t.withColumn(name, F.explode(numbers))
    steps = legs.withColumn("level", F.explode(F.array(*[F.lit(k) for k in held]))) if held else legs.withColumn("level", F.lit(0))
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / (F.pow(F.lit(2.0), F.col("level")) * size)).cast("int"))
    steps = steps.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c, k: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * (k / F.col("n"))
    ends = {f"p{c}{i}": f(at(c, F.col("k")), at(c, F.col("k") + 1)) for c in "xy" for i, f in (("1", F.least), ("2", F.greatest))}
    steps = steps.withColumns(ends)
    for name, numbers in zip(("ubx", "uby"), _buckets(["px1", "py1", "px2", "py2"], size, "level"), strict=True):
        steps = steps.withColumn(name, F.explode(numbers))
    met = steps.select("line_id", "seq", "x0", "y0", "x1", "y1", "length", "cum", "level", "ubx", "uby").distinct().join(t, ["level", "ubx", "uby"])
    return _stretches(met)


def _stretches(met: DataFrame) -> DataFrame:
    """The stretches of segments (x0, y0, x1, y1, length, cum) in faces (ax, ay, az, bx, ...), each once.

    A point's place by one side is its distance on the left of it, times the side's length; it changes evenly along a segment,
    and the face is where all three have the sign of its area.
    """
    area = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    met = met.withColumn("area", area).where("area <> 0").withColumn("span", F.greatest(F.col("tx2") - F.col("tx1"), F.col("ty2") - F.col("ty1")))
    flat = F.col("span") * (F.col("span") + F.col("length")) * 1e-12
    for name, p, q in (("c", "a", "b"), ("a", "b", "c"), ("b", "c", "a")):  # each side has the name of the corner it faces
        for e in "01":
            left = (F.col(f"{q}x") - F.col(f"{p}x")) * (F.col(f"y{e}") - F.col(f"{p}y")) - (F.col(f"{q}y") - F.col(f"{p}y")) * (F.col(f"x{e}") - F.col(f"{p}x"))
            met = met.withColumn(f"{name}{e}", left * F.signum("area"))
            met = met.withColumn(f"{name}{e}", F.when(F.abs(f"{name}{e}") <= flat, F.lit(0.0)).otherwise(F.col(f"{name}{e}")))
    crossing = lambda n: F.try_divide(F.col(f"{n}0"), F.col(f"{n}0") - F.col(f"{n}1"))
    enters = [F.when(F.col(f"{n}1") > F.col(f"{n}0"), crossing(n)).otherwise(F.lit(0.0)) for n in "abc"]
    leaves = [F.when(F.col(f"{n}1") < F.col(f"{n}0"), crossing(n)).otherwise(F.when(F.col(f"{n}1") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))) for n in "abc"]
    met = met.withColumns({"t0": F.greatest(F.lit(0.0), *enters), "t1": F.least(F.lit(1.0), *leaves)}).where("t1 > t0 + 1e-12")
    for e in "01":
        share = lambda n: (F.col(f"{n}0") + F.col(f"t{e}") * (F.col(f"{n}1") - F.col(f"{n}0"))) / F.abs("area")  # noqa: B023, E731
        met = met.withColumns({f"ch{e}": F.col("cum") + F.col(f"t{e}") * F.col("length"), f"z{e}": share("a") * F.col("az") + share("b") * F.col("bz") + share("c") * F.col("cz")})
    same = [F.round(F.col(c) * 1e6).cast("long").alias(f"k{c}") for c in ("ch0", "ch1")]
    one = met.groupBy("line_id", "seq", *same).agg(F.min_by(F.struct("fid", "ch0", "z0", "ch1", "z1"), "fid").alias("s"))
    one = saved(one.select("line_id", "seq", "s.*", "kch0", "kch1"))
    ends = one.select("line_id", F.explode(F.sequence(F.col("kch1") - 1, F.col("kch1") + 1)).alias("kch0"), F.lit(True).alias("joined")).distinct()
    return one.join(ends, ["line_id", "kch0"], "left").select("line_id", "seq", "fid", "ch0", "z0", "ch1", "z1", F.coalesce("joined", F.lit(False)).alias("joined"))
