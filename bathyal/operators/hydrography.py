"""Hydrographic checks and chart products: order limits, crosslines, multi-hypothesis estimation, safety surfaces, soundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bathyal.functions.expressions import SIGMA_95, cell as cell_of
from bathyal.operators.grid import block, median_surface, surface_at, window_max
from bathyal.operators.flow import cell_components, holes
from bathyal.operators.graph import saved
from bathyal.operators.knn import pairs_within

#: Order, TVU a and b, THU c and p, coverage in percent, feature size in metres; strictest first.
ORDERS = [
    ("exclusive", 0.15, 0.0075, 1.0, 0.0, 200, 0.5),
    ("special", 0.25, 0.0075, 2.0, 0.0, 100, 1.0),
    ("1a", 0.5, 0.013, 5.0, 0.05, 100, 2.0),
    ("1b", 0.5, 0.013, 5.0, 0.05, 5, None),
    ("2", 1.0, 0.023, 20.0, 0.10, 5, None),
]
#: Fixed value: the least vertical uncertainty of a sounding, in metres.
LEAST_SIGMA = 1e-4
#: Standard depths of chart contours, in metres.
STANDARD_DEPTHS = (0, 2, 5, 10, 15, 20, 25, 30, 40, 50, 100, 200, 500, 1000)


def orders(spark: SparkSession) -> DataFrame:
    """The order table: five rows."""
    shape = "name string, a double, b double, c double, p double, coverage int, feature double, strictness int"
    return spark.createDataFrame([(*o, i) for i, o in enumerate(ORDERS)], shape)


def tvu(depth: Column) -> Column:
    return F.sqrt(F.col("a") * F.col("a") + (F.col("b") * depth) * (F.col("b") * depth))


def thu(depth: Column) -> Column:
    return F.col("c") + F.col("p") * depth


def feature_size(order: str, depth: Column) -> Column:
    size = next(o[6] for o in ORDERS if o[0] == order)
    plain = F.lit(size).cast("double")
    return F.when(depth > 40, 0.1 * depth).otherwise(plain) if order == "1a" else plain


def within_orders(rows: DataFrame, measured: Column, depth: Column) -> DataFrame:
    """Per order the share of rows, in percent, whose measured value is within its TVU. Orders are a table of five rows."""
    table = F.broadcast(orders(rows.sparkSession))
    joined = rows.where(measured.isNotNull()).crossJoin(table)
    ok = (F.abs(measured) <= tvu(depth)).cast("double")
    return joined.groupBy("name", "strictness").agg((F.avg(ok) * 100).alias("pct"), F.count(F.lit(1)).alias("n"))


def best_order(shares: DataFrame, need: float = 95.0) -> DataFrame:
    """The strictest order that enough of the rows meet."""
    return shares.where(F.col("pct") >= need).agg(F.min_by("name", "strictness").alias("best"))


def residual_stats(residual: DataFrame) -> DataFrame:
    r = F.col("residual")
    return residual.where(r.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("std"),
        F.percentile(r, F.lit(0.5)).alias("median"),
        F.percentile(F.abs(r), F.lit(0.95)).alias("p95"),
        F.max(F.abs(r)).alias("most"),
    )


def crosslines(main: DataFrame, cross: DataFrame, cell: float, min_points: int = 3) -> DataFrame:
    """cross with residual: its z less the main lines' median surface."""
    at = surface_at(cross, median_surface(main, cell, min_points), cell)
    return at.withColumn("residual", F.col("z") - F.col("ref"))


def compliance_grid(rows: DataFrame, cell: float, residual: Column, limit: Column) -> DataFrame:
    keyed = rows.where(residual.isNotNull()).groupBy(cell_of("y", cell).alias("row"), cell_of("x", cell).alias("col"))
    return keyed.agg((F.avg((F.abs(residual) <= limit).cast("double")) * 100).alias("pct"), F.count(F.lit(1)).alias("n"))


def coverage(points: DataFrame, cell: float, min_points: int = 1) -> DataFrame:
    """Cells in the bounding rows and columns of each row of cells, those filled, and the share: holes between the outermost
    filled cells of a row count as area."""
    cells = points.groupBy(cell_of("y", cell).alias("row"), cell_of("x", cell).alias("col")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.where(F.col("n") >= min_points).groupBy("row").agg((F.max("col") - F.min("col") + 1).alias("area"), F.count(F.lit(1)).alias("filled"))
    return rows.agg(F.sum("area").alias("area"), F.sum("filled").alias("filled"), (F.sum("filled") / F.sum("area") * 100).alias("pct"))


def feature_density(points: DataFrame, order: str, depth: Column) -> DataFrame:
    """feature_m, spacing_m, ok: whether three soundings at the mean spacing fit into the order's feature size at the median depth; one row."""
    size = next(o[6] for o in ORDERS if o[0] == order)
    row = points.agg(F.percentile(depth, F.lit(0.5)).alias("median"), F.sqrt((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) / F.count(F.lit(1))).alias("spacing_m"))
    row = row.select(feature_size(order, F.col("median")).alias("feature_m") if size is not None else F.lit(None).cast("double").alias("feature_m"), "spacing_m")
    return row.select("feature_m", "spacing_m", (F.col("spacing_m") <= F.col("feature_m") / 3).alias("ok"))


def order_limits(spark: SparkSession, depth: float) -> DataFrame:
    """Per order the 95 % limits at a depth."""
    return orders(spark).select("name", "strictness", tvu(F.lit(depth)).alias("tvu"), thu(F.lit(depth)).alias("thu"))


def covered_area(points: DataFrame, cell: float, min_points: int = 1, close_cells: int = 2) -> DataFrame:
    """row, col, filled: the surveyed area's cells and whether each holds min_points.

    The area is the occupied cells closed by close_cells (a square grows over them that often and shrinks back), with the holes
    inside filled.
    """
    cells = points.groupBy(cell_of("y", cell).alias("row"), cell_of("x", cell).alias("col")).agg(F.count(F.lit(1)).alias("n"))
    cells = saved(cells.withColumn("filled", F.col("n") >= min_points))
    step = F.sequence(F.lit(-close_cells), F.lit(close_cells))
    grown = cells.select("row", F.explode(F.transform(step, lambda d: F.col("col") + d)).alias("col")).distinct()
    grown = grown.select(F.explode(F.transform(step, lambda d: F.col("row") + d)).alias("row"), "col").distinct()
    width = 2 * close_cells + 1  # a cell stays if all cells around it have been grown over
    kept = grown.select("row", F.explode(F.transform(step, lambda d: F.col("col") + d)).alias("col")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == width)
    kept = kept.select(F.explode(F.transform(step, lambda d: F.col("row") + d)).alias("row"), "col").groupBy("row", "col").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == width)
    closed = saved(kept.select("row", "col").union(cells.select("row", "col")).distinct())
    area = closed.union(holes(closed).select("row", "col"))
    return area.join(cells.select("row", "col", "filled"), ["row", "col"], "left").select("row", "col", F.coalesce("filled", F.lit(False)).alias("filled"))


def holidays(area: DataFrame) -> DataFrame:
    """cells, filled, holiday_cells, holidays (4-connected gaps) and pct of covered_area's cells; one row."""
    gaps = cell_components(area.where("not filled").select("row", "col"), diagonal=False)
    parts = gaps.agg(F.count_distinct("component").alias("holidays"))
    total = area.agg(F.count(F.lit(1)).alias("cells"), F.count_if("filled").alias("filled"), F.count_if(~F.col("filled")).alias("holiday_cells"))
    return total.crossJoin(F.broadcast(parts)).withColumn("pct", F.col("filled") / F.col("cells") * 100)  # each is one row


def map_cell(points: DataFrame, cell: float, max_cells: float = 40e6) -> DataFrame:
    """cell: enlarged where the points' extent would need more cells than max_cells; one row."""
    span = lambda c: F.max(c) - F.min(c)
    n = (span("x") / cell + 1) * (span("y") / cell + 1)
    return points.agg(F.when(n > max_cells, cell * F.sqrt(n / max_cells)).otherwise(F.lit(cell)).alias("cell"))


def assess(points: DataFrame, order: str = "1a", own_tvu: Column | None = None, reference_cell: float = 1.0, cross: DataFrame | None = None, coverage_cell: float | None = None, min_points: int = 1, coverage: bool = True) -> dict[str, DataFrame]:
    """Tables of an assessment: depths, limits, residuals and shares within each order's limits, points over the limit,
    crosslines, coverage and feature density. points: point_id, x, y, z (heights)."""
    depth = F.abs("z")
    at = surface_at(points, median_surface(points, reference_cell), reference_cell)
    rest = saved(at.withColumn("residual", F.col("z") - F.col("ref")))
    o = next(o for o in ORDERS if o[0] == order)
    limit = F.sqrt(F.lit(o[1] ** 2) + (o[2] * depth) * (o[2] * depth))
    spark = points.sparkSession
    depths = points.agg(F.count(F.lit(1)).alias("points"), F.min(depth).alias("depth_min"), F.max(depth).alias("depth_max"), F.percentile(depth, F.lit(0.5)).alias("depth_median"))
    median = depths.first()["depth_median"]
    out = {
        "depths": depths,
        "limits": order_limits(spark, float(median or 0.0)),
        "residuals": residual_stats(rest),
        "aposteriori": within_orders(rest, F.col("residual"), depth),
        "over_limit": rest.where(F.abs("residual") > limit).select("point_id", "residual", limit.alias("limit")),
        "feature": feature_density(points, order, depth),
    }
    if own_tvu is not None:
        out["apriori"] = within_orders(points, own_tvu, depth)
    if cross is not None:
        compared = crosslines(points, cross, reference_cell)
        out["crosslines"] = residual_stats(compared)
        out["crosslines_by_order"] = within_orders(compared, F.col("residual"), depth)
    if coverage:
        out["coverage"] = holidays(covered_area(points, coverage_cell or float(o[6] or 1.0), min_points))
    return out


def resolve_uncertainty(rows: DataFrame, own: Column, depth: Column, order: str = "1a") -> DataFrame:
    """sigma from an own 95 % value; where that is missing, negative or not finite, from the order's limit."""
    o = next(o for o in ORDERS if o[0] == order)
    good = F.when(own.isNotNull() & ~F.isnan(own) & (own >= 0) & (own < float("inf")), own)
    model = F.sqrt(F.lit(o[1] ** 2) + (o[2] * depth) * (o[2] * depth))
    return rows.withColumns({"sigma": F.coalesce(good, model) / SIGMA_95, "from_model": good.isNull()})


def apply_separation(rows: DataFrame, separation: Column, missing_keeps: bool = True) -> DataFrame:
    """z less the datum separation; where there is none points keep their z and grid cells lose it."""
    moved = F.col("z") - separation
    return rows.withColumns({"z": F.coalesce(moved, F.col("z")) if missing_keeps else moved, "unmoved": separation.isNull()})


# ---- multi-hypothesis estimation ---------------------------------------------------------------------------------------


def node_of(value: str, rho: float) -> Column:
    """The number of the node of the cell that holds a coordinate; the node lies at the cell's centre."""
    return cell_of(value, rho)


def contributions(points: DataFrame, rho: float, sigma: Column, sigma_h: Column, capture_pct: float = 5.0, s_h: float = SIGMA_95, alpha: float = 2.0) -> DataFrame:
    """Each sounding at the nodes that it reaches (at most 3 x 3), with its propagated variance.

    Capture distance: a share of the depth, between 0.75 and 1.5 node spacings. Nodes lie at the centres of cells of size rho;
    only nodes within the rows and columns of the soundings' own cells take part.
    """
    reach = F.greatest(F.lit(0.75 * rho), F.least(F.lit(1.5 * rho), F.abs("z") * capture_pct / 100))
    span = F.sequence(F.lit(-1), F.lit(1))
    own_i, own_j = node_of("x", rho), node_of("y", rho)
    box = points.agg(*[f(c).alias(n) for f, c, n in ((F.min, own_i, "i1"), (F.max, own_i, "i2"), (F.min, own_j, "j1"), (F.max, own_j, "j2"))])
    rows = points.select("point_id", "x", "y", "z", F.greatest(sigma, F.lit(LEAST_SIGMA)).alias("sv"), F.coalesce(F.nanvl(sigma_h, F.lit(0.0)), F.lit(0.0)).alias("sh"), reach.alias("reach"))
    rows = rows.withColumn("i", F.explode(F.transform(span, lambda d: node_of("x", rho) + d)))
    rows = rows.withColumn("j", F.explode(F.transform(span, lambda d: node_of("y", rho) + d)))
    rows = rows.crossJoin(F.broadcast(box)).where("i between i1 and i2 and j between j1 and j2")  # box is one row
    r = F.sqrt(F.pow(F.col("x") - (F.col("i") + 0.5) * rho, 2) + F.pow(F.col("y") - (F.col("j") + 0.5) * rho, 2))
    rows = rows.withColumn("r", r).where(F.col("r") <= F.col("reach"))
    var = F.col("sv") * F.col("sv") * (1 + F.pow((F.col("r") + s_h * F.col("sh")) / rho, alpha))
    return rows.select("point_id", "i", "j", "z", var.alias("var"))


def hypotheses(contributed: DataFrame, k_h: float = 3.0) -> DataFrame:
    """i, j, hyp, n, mean, var (of the mean), spread: soundings of a node in order of z, split where the gap exceeds k_h
    combined deviations."""
    w = Window.partitionBy("i", "j").orderBy("z", "point_id")
    gap = F.col("z") - F.lag("z").over(w) > k_h * F.sqrt(F.col("var") + F.lag("var").over(w))
    split = contributed.withColumn("hyp", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("hyp", F.sum("hyp").over(w))
    inverse = 1 / F.col("var")
    rows = split.withColumn("w", inverse).groupBy("i", "j", "hyp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("z")).alias("swz"), F.sum(F.col("w") * F.col("z") * F.col("z")).alias("swzz")
    )
    mean = F.col("swz") / F.col("sw")
    spread = F.greatest(F.lit(0.0), F.col("swzz") / F.col("sw") - mean * mean)
    return rows.select("i", "j", "hyp", "n", mean.alias("mean"), (1 / F.col("sw")).alias("var"), spread.alias("spread"))


def neighbour_median(chosen: DataFrame, size: int) -> DataFrame:
    """i, j, target: the median of z over the nodes within size x size nodes; nodes without a depth take no part."""
    reach = size // 2
    rows = F.sequence(F.col("j") - reach, F.col("j") + reach)
    spread = chosen.select("i", F.explode(rows).alias("j"), "z")  # every node's depth in the rows that it counts in
    strip = spread.groupBy("i", "j").agg(F.collect_list("z").alias("zs"))  # a column of `size` depths at most
    near = strip.select(F.explode(F.sequence(F.col("i") - reach, F.col("i") + reach)).alias("i"), "j", "zs")
    own = near.join(chosen.select("i", "j"), ["i", "j"], "left_semi")
    values = F.sort_array(F.flatten(F.collect_list("zs")))  # size * size depths at most
    at = lambda k: F.get("v", k.cast("int"))
    n = F.size("v")
    return own.groupBy("i", "j").agg(values.alias("v")).select("i", "j", ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("target"))


def estimate(found: DataFrame, rule: str = "locale", shoal_high: bool = True, prior: Column | None = None, locale_size: int = 11) -> DataFrame:
    """One hypothesis per node: most soundings (density), shoalest with enough support (shoal), nearest to a prior depth (prior,
    and density where there is none), or nearest to the median of the surrounding nodes' densest ones (locale).

    var is the larger of the mean's variance and the soundings' spread.
    """
    node = Window.partitionBy("i", "j")
    rows = found.withColumns({"parts": F.count(F.lit(1)).over(node), "all_n": F.sum("n").over(node)})
    dense = (-F.col("n"), F.col("var"), F.col("hyp"))
    order = F.struct(*dense)
    deviation = F.sqrt(F.col("var") + 1e-6)
    if rule == "shoal":
        strong = F.col("n") >= F.greatest(F.lit(2.0), 0.1 * F.col("all_n"))
        any_strong = F.max(strong.cast("int")).over(node) == 1
        rows = rows.withColumn("ok", F.when(any_strong, strong).otherwise(F.lit(True))).where("ok")
        order = F.struct(-F.col("mean") if shoal_high else F.col("mean"), *dense)
    elif rule == "prior":
        order = F.struct(F.coalesce(F.abs(F.col("mean") - prior) / deviation, F.lit(1e12) - F.col("n")), *dense)
    elif rule == "locale":
        first = rows.groupBy("i", "j").agg(F.min_by("mean", order).alias("z"))
        rows = rows.join(neighbour_median(saved(first), locale_size), ["i", "j"])
        order = F.struct(F.abs(F.col("mean") - F.col("target")) / deviation, *dense)
    best = rows.groupBy("i", "j").agg(F.min_by(F.struct("mean", F.greatest("var", "spread").alias("var"), "n", "parts"), order).alias("b"))
    return best.select("i", "j", F.col("b.mean").alias("z"), F.col("b.var").alias("var"), F.col("b.n").alias("n"), F.col("b.parts").alias("hypotheses"))


def flags(points: DataFrame, nodes: DataFrame, rho: float, sigma: Column, k_f: float = 3.0) -> DataFrame:
    """Soundings farther from their own node's depth than k_f combined deviations; those without a node aren't flagged."""
    keyed = points.select("point_id", "z", F.greatest(sigma, F.lit(LEAST_SIGMA)).alias("sv"), node_of("x", rho).alias("i"), node_of("y", rho).alias("j"))
    joined = keyed.join(nodes.select("i", "j", F.col("z").alias("node_z"), "var"), ["i", "j"])
    return joined.where(F.abs(F.col("z") - F.col("node_z")) > k_f * F.sqrt(F.col("sv") * F.col("sv") + F.col("var"))).select("point_id", F.col("node_z"))


# ---- chart products ----------------------------------------------------------------------------------------------------


def safety_surface(surface: DataFrame, bias_cells: int = 1) -> DataFrame:
    return window_max(surface, bias_cells)


def depth_class_area(surface: DataFrame, area: float, levels: tuple[float, ...] = STANDARD_DEPTHS) -> DataFrame:
    """Area per depth band; band k holds depths from levels[k] on."""
    depth = -F.col("z")
    band = sum((depth >= float(v)).cast("int") for v in levels) - 1
    return surface.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * area).alias("area"))


def valsou(depth: Column) -> Column:
    """A depth to the decimetre, towards shoaler."""
    return F.floor(depth * 10 + 1e-6) / 10


def chart_depth(depth: Column) -> Column:
    """A depth to the centimetre, towards shoaler, as exchange products hold it."""
    return F.floor(depth * 100 + 1e-6) / 100


def chart_uncertainty(value: Column) -> Column:
    return F.ceil(value * 100 - 1e-6) / 100


def select_soundings(points: DataFrame, radius: float, high: bool = True) -> DataFrame:
    """The soundings that shoal-first suppression keeps: each kept one drops all others nearer than the radius.

    The greedy order is met in rounds: a sounding that is first among the undecided ones around it is kept, those around it
    are dropped; this gives the greedy result whatever the partitioning. Ties go to the smaller id.
    """
    left = points.select("point_id", "x", "y", (-F.col("z") if high else F.col("z")).alias("up"))
    near = pairs_within(left, left, radius, ("x", "y"), carry=("up",))
    better = F.struct("b_up", "b") < F.struct("a_up", "a")
    edges = saved(near.where((F.col("a") != F.col("b")) & (F.col("d") < radius) & better).select("a", "b"))
    undecided, kept = saved(left.select("point_id")), None
    while True:
        blocked = edges.select(F.col("a").alias("point_id")).distinct()
        first = saved(undecided.join(blocked, "point_id", "left_anti"))
        kept = first if kept is None else kept.union(first)
        dropped = edges.join(first.select(F.col("point_id").alias("b")), "b").select(F.col("a").alias("point_id")).distinct()
        gone = first.union(dropped)
        undecided = saved(undecided.join(gone, "point_id", "left_anti"))
        if undecided.isEmpty():
            return points.join(kept, "point_id", "left_semi")
        edges = saved(edges.join(gone.select(F.col("point_id").alias("a")), "a", "left_anti").join(gone.select(F.col("point_id").alias("b")), "b", "left_anti"))


def product_grid(surface: DataFrame, factor: int) -> DataFrame:
    """Coarser cells with the shoalest depth, floored to the centimetre."""
    return block(surface, factor).select("row", "col", chart_depth(-F.col("z")).alias("depth"))
