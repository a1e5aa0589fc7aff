"""Triangle meshes: vertex (mesh_id, vid, x, y, z) and face (mesh_id, fid, a, b, c) tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bathyal.functions.expressions import cell as cell_of
from bathyal.operators.graph import components, saved

#: Cells that `rasterize` looks at in one step.
CELLS = 1 << 18


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces with the coordinates ax, ay, az, bx, ... of their corners."""
    for k in ("a", "b", "c"):
        v = vertices.select("mesh_id", F.col("vid").alias(k), *[F.col(x).alias(f"{k}{x}") for x in ("x", "y", "z")])
        faces = faces.join(v, ["mesh_id", k])
    return faces


def numbered_vertices(vertices: DataFrame) -> DataFrame:
    """vertices with n: their place from 1 in order of mesh and number. Ranges are sorted and counted each for itself; their
    counts, a row for each range, tell where each begins."""
    ranged = saved(vertices.repartitionByRange("mesh_id", "vid").sortWithinPartitions("mesh_id", "vid").withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    counts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = ranged.withColumn("part", part).join(F.broadcast(starts), "part")
    return placed.withColumn("n", F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1) + 1).drop("id", "part", "before")


def bbox(vertices: DataFrame) -> DataFrame:
    """The least and the greatest of each coordinate of each mesh."""
    return vertices.groupBy("mesh_id").agg(*[f(c).alias(f"{c}_{n}") for c in ("x", "y", "z") for f, n in ((F.min, "min"), (F.max, "max"))])


def transfer_colors(vertices: DataFrame, points: DataFrame, start: float) -> DataFrame:
    """vertices with r, g and b of the nearest point (point_id, x, y, z, r, g, b)."""
    from bathyal.operators.knn import knn

    keyed = vertices.select(F.xxhash64("mesh_id", "vid").alias("point_id"), "x", "y", "z")
    near = knn(keyed, points, 1, start).join(points.select(F.col("point_id").alias("b"), F.struct("r", "g", "b").alias("colour")), "b")
    found = near.select(F.col("a").alias("key"), "colour")
    out = vertices.withColumn("key", F.xxhash64("mesh_id", "vid")).join(found, "key", "left")
    return out.select(*vertices.columns, "colour.r", "colour.g", "colour.b")


def vertex_shade(faces: DataFrame, vertices: DataFrame, light: tuple[float, float, float], ambient: float, z_scale: float = 1.0) -> DataFrame:
    """mesh_id, vid, shade: brightness under a light from a direction; face normals point up and count by their area."""
    x, y, z = _cross()
    scaled = vertices.withColumn("z", F.col("z") * z_scale)
    up = F.when(z < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    f = corners(faces, scaled).select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid"), (x * up).alias("nx"), (y * up).alias("ny"), (z * up).alias("nz"))
    n = f.groupBy("mesh_id", "vid").agg(*[F.sum(c).alias(c) for c in ("nx", "ny", "nz")])
    size = F.greatest(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")), F.lit(1e-12))
    lit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("nx") * light[0] + F.col("ny") * light[1] + F.col("nz") * light[2]) / size))
    return n.select("mesh_id", "vid", (ambient + (1 - ambient) * lit).alias("shade"))


def _cross() -> tuple[Column, Column, Column]:
    u = [F.col(f"b{x}") - F.col(f"a{x}") for x in ("x", "y", "z")]
    v = [F.col(f"c{x}") - F.col(f"a{x}") for x in ("x", "y", "z")]
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def face_areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    x, y, z = _cross()
    return corners(faces, vertices).select("mesh_id", "fid", (F.sqrt(x * x + y * y + z * z) / 2).alias("area"))


def volume(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """The signed volume of each closed mesh."""
    b = [F.col(f"b{x}") for x in ("x", "y", "z")]
    c = [F.col(f"c{x}") for x in ("x", "y", "z")]
    det = F.col("ax") * (b[1] * c[2] - b[2] * c[1]) + F.col("ay") * (b[2] * c[0] - b[0] * c[2]) + F.col("az") * (b[0] * c[1] - b[1] * c[0])
    return corners(faces, vertices).groupBy("mesh_id").agg((F.sum(det) / 6).alias("volume"))


def edges(faces: DataFrame) -> DataFrame:
    """mesh_id, lo, hi and the number of faces of each edge."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"))
    each = faces.select("mesh_id", F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("a", "c"))).alias("e"))
    return each.groupBy("mesh_id", "e.lo", "e.hi").agg(F.count(F.lit(1)).alias("faces"))


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edges(faces).where("faces = 1").select("mesh_id", "lo", "hi")


def clean(faces: DataFrame) -> DataFrame:
    """Without faces that name a vertex twice, and without all but the first of faces with equal corners."""
    good = faces.where("a <> b and b <> c and a <> c").withColumn("key", F.sort_array(F.array("a", "b", "c")))
    return good.groupBy("mesh_id", "key").agg(F.min_by(F.struct("fid", "a", "b", "c"), "fid").alias("f")).select("mesh_id", "f.*")


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Area-weighted unit normals."""
    x, y, z = _cross()
    f = corners(faces, vertices).select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid"), x.alias("nx"), y.alias("ny"), z.alias("nz"))
    n = f.groupBy("mesh_id", "vid").agg(*[F.sum(c).alias(c) for c in ("nx", "ny", "nz")])
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return n.select("mesh_id", "vid", *[F.when(size > 0, F.col(c) / size).otherwise(F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")])


def large_components(faces: DataFrame, vertices: DataFrame, min_area: float) -> DataFrame:
    """Faces of one mesh whose vertex-connected component has at least min_area."""
    e = edges(faces)
    label = components(vertices.select(F.col("vid").alias("id")), e.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    part = faces.join(label.select(F.col("id").alias("a"), "component"), "a").join(face_areas(faces, vertices).select("fid", "area"), "fid")
    large = part.groupBy("component").agg(F.sum("area").alias("total")).where(F.col("total") >= min_area)
    return part.join(large.select("component"), "component", "left_semi").select("mesh_id", "fid", "a", "b", "c")


def taubin_smooth(vertices: DataFrame, faces: DataFrame, iterations: int = 5, lam: float = 0.5, mu: float = -0.53) -> DataFrame:
    """Moves inner vertices towards and away from their neighbours' mean in turn; boundary vertices stay."""
    e = saved(edges(faces))
    near = saved(e.select("mesh_id", F.col("lo").alias("vid"), F.col("hi").alias("other")).union(e.select("mesh_id", F.col("hi"), F.col("lo"))))
    fixed = e.where("faces = 1").select("mesh_id", F.explode(F.array("lo", "hi")).alias("vid")).distinct().withColumn("fixed", F.lit(True))
    now = vertices.join(fixed, ["mesh_id", "vid"], "left")
    for _ in range(iterations):
        for step in (lam, mu):
            place = now.select("mesh_id", F.col("vid").alias("other"), "x", "y", "z")
            mean = near.join(place, ["mesh_id", "other"]).groupBy("mesh_id", "vid").agg(*[F.avg(c).alias(f"m{c}") for c in ("x", "y", "z")])
            moved = now.join(mean, ["mesh_id", "vid"], "left")
            go = F.when(F.col("fixed").isNull(), F.lit(step)).otherwise(F.lit(0.0))
            now = moved.select("mesh_id", "vid", *[(F.col(c) + go * (F.coalesce(f"m{c}", c) - F.col(c))).alias(c) for c in ("x", "y", "z")], "fixed")
        now = saved(now)
    return now.drop("fixed")


def decimate(vertices: DataFrame, faces: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Vertices become their voxel's mean; faces that collapse are dropped."""
    keyed = vertices.select("mesh_id", "vid", "x", "y", "z", *[cell_of(c, size).alias(f"v{c}") for c in ("x", "y", "z")])
    keys = ["mesh_id", "vx", "vy", "vz"]
    new = keyed.groupBy(*keys).agg(F.min("vid").alias("new"), *[F.avg(c).alias(c) for c in ("x", "y", "z")])
    ids = keyed.join(new.select(*keys, "new"), keys).select("mesh_id", "vid", "new")
    out = faces
    for k in ("a", "b", "c"):
        out = out.join(ids.select("mesh_id", F.col("vid").alias(k), F.col("new").alias(f"n{k}")), ["mesh_id", k])
    out = out.select("mesh_id", "fid", F.col("na").alias("a"), F.col("nb").alias("b"), F.col("nc").alias("c"))
    return new.select("mesh_id", F.col("new").alias("vid"), "x", "y", "z"), clean(out)


def merge(meshes: Sequence[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """All meshes as one table each of vertices and faces, told apart by mesh_id."""
    vertices, faces = None, None
    for i, (v, f) in enumerate(meshes):
        v, f = v.withColumn("mesh_id", F.lit(i)), f.withColumn("mesh_id", F.lit(i))
        vertices, faces = (v, f) if vertices is None else (vertices.unionByName(v), faces.unionByName(f))
    return vertices, faces


def rasterize(faces: DataFrame, vertices: DataFrame | None, cell: float) -> DataFrame:
    """row, col, z at centres of cells that a face covers; of several faces the last one counts. vertices: None where faces have
    the places of their corners."""
    kind = faces.schema["fid"].dataType.simpleString()

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, z = (np.stack([batch.column(k + c).to_numpy(zero_copy_only=False) for k in "abc"]).astype(np.float64) for c in "xyz")
            lost = np.any([batch.column(f"{k}z").is_null().to_numpy(zero_copy_only=False) for k in "abc"], axis=0)
            good = np.flatnonzero(np.isfinite(x).all(0) & np.isfinite(y).all(0))
            first, size = [], []
            for v in (x[:, good], y[:, good]):
                low, high = np.ceil(v.min(0) / cell - 0.5 - 1e-9), np.floor(v.max(0) / cell - 0.5 + 1e-9)
                first.append(low.astype(np.int64))
                size.append(np.maximum(0, high - low + 1).astype(np.int64))
            ends = np.cumsum(size[0] * size[1])
            for begin in range(0, int(ends[-1]) if len(ends) else 0, CELLS):  # cells of all boxes of faces, some at a time
                place = np.arange(begin, min(begin + CELLS, int(ends[-1])))
                face = np.searchsorted(ends, place, "right")
                place -= ends[face] - size[0][face] * size[1][face]
                row, col = first[1][face] + place // size[0][face], first[0][face] + place % size[0][face]
                face = good[face]
                (ax, bx, cx), (ay, by, cy) = x[:, face], y[:, face]
                px, py = (col + 0.5) * cell, (row + 0.5) * cell
                det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
                with np.errstate(divide="ignore", invalid="ignore"):
                    wa = ((by - cy) * (px - cx) + (cx - bx) * (py - cy)) / det
                    wb = ((cy - ay) * (px - cx) + (ax - cx) * (py - cy)) / det
                on = (det != 0) & (wa >= -1e-9) & (wb >= -1e-9) & (wa + wb <= 1 + 1e-9)
                face, wa, wb = face[on], wa[on], wb[on]
                height = wa * z[0, face] + wb * z[1, face] + (1 - wa - wb) * z[2, face]
                columns = [pa.array(row[on]), pa.array(col[on]), batch.column("fid").take(pa.array(face)), pa.array(height, mask=lost[face])]
                yield pa.RecordBatch.from_arrays(columns, ["row", "col", "fid", "z"])

    f = corners(faces, vertices) if vertices is not None else faces
    places = [F.col(f"{k}{c}").cast("double").alias(f"{k}{c}") for k in "abc" for c in "xyz"]
    f = f.select("fid", *places).mapInArrow(covered, f"row long, col long, fid {kind}, z double")
    return f.groupBy("row", "col").agg(F.max_by("z", "fid").alias("z"))


def grid_mesh(surface: DataFrame, cell: float, stride: int = 1) -> tuple[DataFrame, DataFrame]:
    """A surface's every stride-th cell as a mesh of two triangles per square whose corners all hold data."""
    rows = surface.where(f"pmod(row, {stride}) = 0 and pmod(col, {stride}) = 0").select((F.col("row") / stride).cast("long").alias("r"), (F.col("col") / stride).cast("long").alias("c"), "z")
    vid = F.xxhash64("r", "c")
    vertices = rows.select(F.lit(0).alias("mesh_id"), vid.alias("vid"), ((F.col("c") * stride + 0.5) * cell).alias("x"), ((F.col("r") * stride + 0.5) * cell).alias("y"), "z")
    squares = rows.select("r", "c", vid.alias("v00"))
    for name, dr, dc in (("v01", 0, 1), ("v10", 1, 0), ("v11", 1, 1)):
        other = rows.select((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), vid.alias(name))
        squares = squares.join(other, ["r", "c"])
    two = F.array(F.struct(F.lit(0).alias("h"), F.col("v00").alias("a"), F.col("v01").alias("b"), F.col("v11").alias("c")), F.struct(F.lit(1).alias("h"), F.col("v00").alias("a"), F.col("v11").alias("b"), F.col("v10").alias("c")))
    faces = squares.select("r", F.col("c").alias("k"), F.explode(two).alias("t"))
    return vertices, faces.select(F.lit(0).alias("mesh_id"), F.xxhash64("r", "k", "t.h").alias("fid"), "t.a", "t.b", "t.c")
