"""Points: activity, selection sets, subsets, description and the edit log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bathyal.functions.expressions import UNROLLED, in_polygon, noise, segment_offsets


def active(points: DataFrame, hide_noise: bool = True) -> DataFrame:
    """Points that are in no trash batch and, unless noise is shown, of no rejected class."""
    kept = points.where(F.coalesce("deleted_batch", F.lit(0)) == 0) if "deleted_batch" in points.columns else points
    return kept.where(~noise(F.col("classification"))) if hide_noise else kept


def with_classes(points: DataFrame) -> DataFrame:
    """Points with a class column; without one all are of class 1."""
    return points if "classification" in points.columns else points.withColumn("classification", F.lit(1))


def set_class(points: DataFrame, edits: DataFrame) -> DataFrame:
    """Writes new classes (point_id, new_class); orig_class keeps what was there before the first edit."""
    before = F.coalesce("orig_class", "classification") if "orig_class" in points.columns else F.col("classification")
    new = edits.select("point_id", "new_class")
    joined = points.join(new, "point_id", "left").withColumn("orig_class", before)
    return joined.withColumn("classification", F.coalesce("new_class", "classification")).drop("new_class")


def original_class(points: DataFrame) -> DataFrame:
    """Restores classes; a point that was rejected from the start becomes class 1."""
    return points.withColumn("classification", F.when(noise(F.col("orig_class")), F.lit(1)).otherwise(F.col("orig_class")))


def selection(selected: DataFrame, picked: DataFrame, op: str = "replace") -> DataFrame:
    """Sets of point_id: replace, add, subtract."""
    a, b = selected.select("point_id"), picked.select("point_id")
    if op == "replace":
        return b.distinct()
    if op == "add":
        return a.union(b).distinct()
    if op == "subtract":
        return a.join(b, "point_id", "left_anti").distinct()
    raise ValueError(f"no such operation: {op}")


def invert(selected: DataFrame, all_active: DataFrame) -> DataFrame:
    return all_active.select("point_id").join(selected.select("point_id"), "point_id", "left_anti")


def outside_range(points: DataFrame, zmin: float, zmax: float) -> DataFrame:
    return points.where((F.col("z") < zmin) | (F.col("z") > zmax))


def box_offsets(points: DataFrame, p0: tuple[float, float], p1: tuple[float, float]) -> DataFrame:
    """along and across of an oriented box that runs from p0 to p1."""
    dx, dy = p1[0] - p0[0], p1[1] - p0[1]
    length = (dx * dx + dy * dy) ** 0.5
    ux, uy = dx / length, dy / length
    x, y = F.col("x") - p0[0], F.col("y") - p0[1]
    return points.withColumns({"along": x * ux + y * uy, "across": x * uy - y * ux})


def box_subset(points: DataFrame, p0: tuple[float, float], p1: tuple[float, float], width: float) -> DataFrame:
    """Points in the box, borders included. The bounding box is a plain predicate that reaches the scan."""
    length = ((p1[0] - p0[0]) ** 2 + (p1[1] - p0[1]) ** 2) ** 0.5
    reach = width / 2
    low, high = (min(p0[0], p1[0]) - reach, min(p0[1], p1[1]) - reach), (max(p0[0], p1[0]) + reach, max(p0[1], p1[1]) + reach)
    near = points.where(F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1]))
    return box_offsets(near, p0, p1).where(F.col("along").between(0, length) & (F.abs("across") <= reach))


def next_box(p0: tuple[float, float], p1: tuple[float, float], overlap: float, direction: int = 1) -> tuple:
    """The box's next page: moved along by its length less the overlap."""
    step = (1 - overlap) * direction
    dx, dy = (p1[0] - p0[0]) * step, (p1[1] - p0[1]) * step
    return (p0[0] + dx, p0[1] + dy), (p1[0] + dx, p1[1] + dy)


def box_coverage(points: DataFrame, boxes: Sequence[tuple]) -> DataFrame:
    """The share of points in at least one box (p0, p1, width)."""
    inside = F.lit(False)
    for p0, p1, width in boxes:
        dx, dy = p1[0] - p0[0], p1[1] - p0[1]
        length = (dx * dx + dy * dy) ** 0.5
        x, y = F.col("x") - p0[0], F.col("y") - p0[1]
        inside = inside | ((x * (dx / length) + y * (dy / length)).between(0, length) & (F.abs(x * (dy / length) - y * (dx / length)) <= width / 2))
    return points.agg(F.avg(inside.cast("double")).alias("share"))


def polygon_subset(points: DataFrame, ring: Sequence[tuple[float, float]]) -> DataFrame:
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    near = points.where(F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys)))
    return near.where(in_polygon(F.col("x"), F.col("y"), ring))


def corridor_points(points: DataFrame, line: Sequence[tuple[float, float]], width: float) -> DataFrame:
    """Points within `width` of a polyline, with chainage, signed offset and distance."""
    xs, ys = [p[0] for p in line], [p[1] for p in line]
    near = points.where(F.col("x").between(min(xs) - width, max(xs) + width) & F.col("y").between(min(ys) - width, max(ys) + width))
    if len(line) > UNROLLED + 1:
        return _bucketed_corridor(near, line, width)
    hit = near.withColumn("hit", segment_offsets(F.col("x"), F.col("y"), line)).where(F.col("hit.dist") <= width)
    return hit.select(*points.columns, F.col("hit.ch").alias("ch"), F.col("hit.off").alias("off"), F.col("hit.dist").alias("dist"))


def _bucketed_corridor(points: DataFrame, line: Sequence[tuple[float, float]], width: float) -> DataFrame:
    """corridor_points for a line of many segments: points meet only segments that reach their bucket."""
    rows, cum = [], 0.0
    for i, ((x1, y1), (x2, y2)) in enumerate(zip(line, line[1:])):
        if length := ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5:
            rows.append((i, float(x1), float(y1), float(x2), float(y2), length, cum))
            cum += length
    if not rows:
        return points.where(F.lit(False)).select(*points.columns, *[F.lit(None).cast("double").alias(c) for c in ("ch", "off", "dist")])
    size = max(2 * width, cum / len(rows))
    legs = points.sparkSession.createDataFrame(rows, "seg int, x1 double, y1 double, x2 double, y2 double, length double, cum double")
    pieces = F.ceil(F.col("length") / size).cast("int")  # a long segment goes to the buckets of its pieces, not to all in its box
    legs = legs.withColumn("n", pieces).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c, k: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * (k / F.col("n"))
    for c in "xy":
        ends = [at(c, F.col("k")), at(c, F.col("k") + 1)]
        legs = legs.withColumn(f"b{c}", F.explode(F.sequence(F.floor((F.least(*ends) - width) / size), F.floor((F.greatest(*ends) + width) / size))))
    legs = legs.drop("n", "k").distinct()
    own = points.select(F.struct(*points.columns).alias("point"), "x", "y").withColumn("row", F.monotonically_increasing_id())
    own = own.withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})
    ux, uy = (F.col("x2") - F.col("x1")) / F.col("length"), (F.col("y2") - F.col("y1")) / F.col("length")
    met = own.join(legs, ["bx", "by"]).withColumns({"ux": ux, "uy": uy})
    along = F.least(F.col("length"), F.greatest(F.lit(0.0), (F.col("x") - F.col("x1")) * F.col("ux") + (F.col("y") - F.col("y1")) * F.col("uy")))
    met = met.withColumn("along", along)
    dx, dy = F.col("x") - (F.col("x1") + F.col("along") * F.col("ux")), F.col("y") - (F.col("y1") + F.col("along") * F.col("uy"))
    across = (F.col("x") - F.col("x1")) * F.col("uy") - (F.col("y") - F.col("y1")) * F.col("ux")
    hit = F.struct(F.sqrt(dx * dx + dy * dy).alias("dist"), "seg", (F.col("along") + F.col("cum")).alias("ch"), across.alias("off"))
    best = met.withColumn("hit", hit).where(F.col("hit.dist") <= width).groupBy("row").agg(F.first("point").alias("point"), F.min("hit").alias("hit"))
    return best.select("point.*", "hit.ch", "hit.off", "hit.dist")


def describe(points: DataFrame) -> DataFrame:
    """Count, extent, centroid and z statistics in one row, with population deviation."""
    return points.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{c}_{name}") for c in ("x", "y", "z") for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
        F.stddev_pop("z").alias("z_std"),
    )


def top_classes(points: DataFrame, most: int = 6) -> DataFrame:
    counts = points.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "classification").limit(most)


def fold_edits(points: DataFrame, log: DataFrame, upto: int | None = None) -> DataFrame:
    """Points with deleted_batch after the log's edits (seq, action, batch, point_id), in order of seq.

    delete puts a point in a batch, restore takes it out, purge makes the batch number negative. Undo is a smaller `upto`.
    """
    log = log if upto is None else log.where(F.col("seq") <= upto)
    last = log.groupBy("point_id").agg(F.max_by(F.struct("action", "batch"), "seq").alias("last"))
    state = F.when(F.col("last.action") == "delete", F.col("last.batch")).when(F.col("last.action") == "purge", -F.col("last.batch"))
    return points.join(last, "point_id", "left").withColumn("deleted_batch", F.coalesce(state, F.lit(0))).drop("last")


def local_coordinates(points: DataFrame) -> DataFrame:
    """x, y and z less the rounded centre of the bounding box, as floats."""
    box = points.agg(*[F.round((F.min(c) + F.max(c)) / 2).alias(f"{c}_mid") for c in ("x", "y", "z")])  # one row
    moved = points.crossJoin(F.broadcast(box))
    return moved.select("point_id", *[(F.col(c) - F.col(f"{c}_mid")).cast("float").alias(c) for c in ("x", "y", "z")])


def pick(points: DataFrame, sx: float, sy: float, radius: float = 8.0) -> DataFrame:
    """Of points with screen place (sx, sy) and depth w the front-most one within the radius."""
    d = F.sqrt(F.pow(F.col("sx") - sx, 2) + F.pow(F.col("sy") - sy, 2))
    near = points.withColumn("score", F.col("w") * (1 + 0.002 * d)).where(d <= radius)
    return near.agg(F.min_by("point_id", F.struct("score", "point_id")).alias("point_id"))


def history(log: DataFrame, limit: int = 200) -> DataFrame:
    """The last `limit` commands that undo can still reach, newest first; a new command after an undo drops what was undone."""
    last = log.where(F.col("kind") == "command").orderBy(F.col("seq").desc()).limit(limit)
    return last.withColumn("back", F.row_number().over(Window.orderBy(F.col("seq").desc())))  # `limit` rows at most
