"""Value ranges, colour positions, ticks and shading, and facts of points, selections and edits that a display shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bathyal.functions.expressions import noise

#: Steps of round numbers, the light's direction (north-west, 45 degrees up) and the share of light without it.
STEPS = (1.0, 2.0, 2.5, 5.0, 10.0)
LIGHT, AMBIENT = (-0.5, 0.5, 0.7071), 0.38
MAX_CELLS = 4_000_000


def nice_number(x: Column) -> Column:
    """x rounded up to 1, 2, 2.5 or 5 times a power of ten; 1 for what isn't a positive number."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    at = F.lit(None)
    for m in reversed(STEPS):
        at = F.when(m * scale >= x * 0.999, m * scale).otherwise(at)
    good = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    return F.when(good, at).otherwise(F.lit(1.0))


def nice_ticks(low: Column, high: Column, target: int = 6) -> Column:
    """An array of the multiples of a round step between two values, about `target` of them."""
    raw = (high - low) / target
    scale = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.lit(10.0) * scale
    for m in reversed(STEPS[:-1]):
        step = F.when(m * scale >= raw, m * scale).otherwise(step)
    first, last = F.ceil(low / step - 1e-9).cast("long"), F.floor(high / step + 1e-9).cast("long")
    ticks = F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.round(i * step, 10))
    return F.when(high > low, F.filter(ticks, lambda t: t <= high + step * 1e-9)).otherwise(F.array().cast("array<double>"))


def _wide(low: Column, high: Column) -> list[Column]:
    """low and high, at least one apart."""
    none = low.isNull() | high.isNull()
    return [F.when(none, 0.0).otherwise(low).alias("low"), F.when(none, 1.0).when(high > low, high).otherwise(low + 1).alias("high")]


def auto_range(rows: DataFrame, value: Column, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """low and high percentiles of the finite values; one row."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    found = rows.agg(F.percentile(finite, F.lit(low / 100)).alias("a"), F.percentile(finite, F.lit(high / 100)).alias("b"))
    return found.select(*_wide(F.col("a"), F.col("b")))


def symmetric_range(rows: DataFrame, value: Column, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """The range about 0 that holds both percentiles."""
    most = F.greatest(F.abs("low"), F.abs("high"), F.lit(1e-3))
    return auto_range(rows, value, low, high).select((-most).alias("low"), most.alias("high"))


def full_range(rows: DataFrame, value: Column) -> DataFrame:
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    found = rows.agg(F.min(finite).alias("a"), F.max(finite).alias("b"))
    return found.select(*_wide(F.col("a"), F.col("b")))


def topo_position(value: Column, low: float, high: float) -> Column:
    """0 to 1 along a palette of sea and land that meet at 0 m; a range on one side of 0 takes that side's half only."""
    span = (high - low) or 1.0
    if high <= 0:
        return 0.5 * (value - low) / span
    if low >= 0:
        return 0.5 + 0.5 * (value - low) / span
    return F.when(value < 0, 0.5 * (value - low) / -low).otherwise(0.5 + 0.5 * value / high)


def palette_slot(value: Column, low: float, high: float, size: int = 256) -> Column:
    """The entry of a palette for a value; values beyond the range take its ends, missing ones the first."""
    at = F.floor((value - low) * (size - 1) / ((high - low) or 1.0))
    return F.coalesce(F.least(F.lit(size - 1), F.greatest(F.lit(0), at)), F.lit(0)).cast("int")


def rgb_colors(points: DataFrame) -> DataFrame:
    """point_id with r, g and b from 0 to 1; values above 255 anywhere mean 16 bits."""
    most = points.agg(F.max(F.greatest("r", "g", "b")).alias("most"))  # one row
    scale = F.when(F.col("most") > 255, 65535.0).otherwise(255.0)
    part = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0)) / scale)).alias(c)
    return points.crossJoin(F.broadcast(most)).select("point_id", part("r"), part("g"), part("b"))


def available_modes(points: DataFrame) -> list[str]:
    """The ways to colour points that their columns allow; colours that are all zero don't count."""
    have = set(points.columns)
    colours = {"r", "g", "b"} <= have and points.where((F.col("r") > 0) | (F.col("g") > 0) | (F.col("b") > 0)).limit(1).count() > 0
    there = [("intensity", "intensity" in have), ("rgb", colours), ("classification", "classification" in have), ("deviation", "deviation" in have)]
    return ["elevation", *(m for m, ok in there if ok), "single"]


def stride(rows: Column, cols: Column, most: int = MAX_CELLS) -> Column:
    """Every how manyeth row and column of a grid is drawn."""
    cells = rows.cast("double") * cols
    return F.when(cells > most, F.ceil(F.sqrt(cells / most))).otherwise(F.lit(1)).cast("int")


def thinned(points: DataFrame, most: int) -> DataFrame:
    """About `most` of the points, by a hash of their id, so that the same ones are drawn each time."""
    share = points.agg((F.lit(float(most)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("share"))  # one row
    u = F.pmod(F.xxhash64("point_id"), F.lit(1 << 20)) / float(1 << 20)
    return points.crossJoin(F.broadcast(share)).where(u < F.col("share")).drop("share")


# ---- facts -------------------------------------------------------------------------------------------------------------


def max_class(points: DataFrame) -> DataFrame:
    """The largest class, 0 without any; one row."""
    return points.agg(F.coalesce(F.max("classification"), F.lit(0)).cast("int").alias("max_class"))


def noise_count(points: DataFrame) -> DataFrame:
    return points.agg(F.count_if(noise(F.col("classification"))).alias("n_noise"))


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{c}_{n}") for c in ("x", "y", "z") for f, n in ((F.min, "min"), (F.max, "max"))])


def box_corners(p0: tuple[float, float], p1: tuple[float, float], width: float) -> list[tuple[float, float]]:
    """The corners of an oriented box, from the start's right side on."""
    dx, dy = p1[0] - p0[0], p1[1] - p0[1]
    length = (dx * dx + dy * dy) ** 0.5
    nx, ny = dy / length * width / 2, -dx / length * width / 2
    return [(p0[0] + nx, p0[1] + ny), (p1[0] + nx, p1[1] + ny), (p1[0] - nx, p1[1] - ny), (p0[0] - nx, p0[1] - ny)]


def cleared(selected: DataFrame) -> DataFrame:
    """The empty selection of the same kind."""
    return selected.where(F.lit(False))


def trash_batches(points: DataFrame) -> DataFrame:
    """batch and n of the deleted points that can be restored, the newest batch first."""
    held = points.where(F.col("deleted_batch") > 0).groupBy(F.col("deleted_batch").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    return held.orderBy(F.col("batch").desc())


def trash_total(points: DataFrame) -> DataFrame:
    return points.agg(F.count_if(F.col("deleted_batch") > 0).alias("total"))


def centres(surface: DataFrame, cell: float) -> DataFrame:
    """surface with the place x, y of each cell's centre."""
    return surface.withColumns({"x": (F.col("col") + 0.5) * cell, "y": (F.col("row") + 0.5) * cell})


#: Names by which attributes of vertical and horizontal uncertainty are known.
HINTS = {
    "tvu": ("tvu", "tpu", "vertical_uncertainty", "vert_unc", "uncertainty", "unc", "depth_tpu", "std_z", "sigma_z", "tpu_v", "dtpu"),
    "thu": ("thu", "horizontal_uncertainty", "hor_unc", "htpu", "tpu_h", "position_tpu", "sigma_xy", "std_xy"),
}


def guess_attribute(names: list[str], kind: str = "tvu") -> str | None:
    """The column that holds an uncertainty: one of the known names, else one that has one of the first three within."""
    known = {n.lower(): n for n in names}
    whole = [known[h] for h in HINTS[kind] if h in known]
    part = [n for n in names if any(h in n.lower() for h in HINTS[kind][:3])]
    return (whole or part or [None])[0]


def depth_of(z: Column, positive_down: bool | None = True) -> Column:
    """Depth from heights (True), from depths (False), or whichever it is (None)."""
    return F.abs(z) if positive_down is None else (-z if positive_down else z)


def dip(nx: Column, ny: Column, nz: Column) -> Column:
    """Degrees from the horizontal of the plane with a unit normal."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(nz))))


def dip_direction(nx: Column, ny: Column, nz: Column) -> Column:
    """Degrees clockwise from north in which that plane falls; 0 for planes that hardly do."""
    up = F.when(nz < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(dip(nx, ny, nz) > 0.5, F.pmod(F.degrees(F.atan2(nx * up, ny * up)), F.lit(360.0))).otherwise(F.lit(0.0))
