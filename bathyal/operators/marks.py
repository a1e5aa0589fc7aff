"""Lane lines, stop lines and crossings from painted points, and poles from columns of points.

Paint hangs together in cells; each connected piece is described by moments, one aggregate for all pieces at once, and pieces
longer than a stripe are cut at their middle until none is left. Stripes become lines where two of their ends choose each other;
the order along a line comes from links that double their reach (`graph.chained`), so no line is one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bathyal.functions.expressions import cell as cell_of
from bathyal.operators.graph import REACH, chained, components, saved
from bathyal.operators.grid import surface_at
from bathyal.operators.knn import pairs_within, placed

#: Cells along a side of the tiles in which cells are linked.
TILE = 1024


def _tile_links(rows: pd.DataFrame, reach: int) -> pd.DataFrame:
    """row, col, region of a tile's own cells, and rows with the region of an own cell that is linked to a cell of another tile
    (far true: row and col are that cell's).

    Blocks of reach by reach cells hang together in themselves. Two blocks that touch are linked where a cell of each is at most
    reach from the other: between blocks side by side the ends tell that, between blocks at a corner a cell of the one must be
    nearer to the corner, both ways together, than a cell of the other.
    """
    rows = rows.sort_values(["row", "col"], kind="stable")
    r, c, own = (rows[k].to_numpy() for k in ("row", "col", "own"))
    br, bc = r // reach, c // reach
    wide = int(bc.max() - bc.min()) + 3
    keys, first, block = np.unique((br - br.min()) * wide + bc - bc.min() + 1, return_index=True, return_inverse=True)
    n, u, v = len(keys), c - bc * reach, r - br * reach
    top, low = np.full((n, reach), -1), np.full((n, reach), reach)  # of the cells in each column of a block
    np.maximum.at(top, (block, u), v)
    np.minimum.at(low, (block, u), v)
    east, west = np.zeros(n, np.int64), np.full(n, reach)
    np.maximum.at(east, block, u)
    np.minimum.at(west, block, u)
    from_right, from_left = np.maximum.accumulate(top[:, ::-1], 1)[:, ::-1], np.maximum.accumulate(top, 1)
    to_left, to_right = np.minimum.accumulate(low, 1), np.minimum.accumulate(low[:, ::-1], 1)[:, ::-1]
    links = []
    for step, near in (
        (1, lambda a, b: west[b] <= east[a]),
        (wide, lambda a, b: low[b].min(1) <= top[a].max(1)),
        (wide + 1, lambda a, b: (to_left[b] <= from_right[a]).any(1)),
        (wide - 1, lambda a, b: (to_right[b] <= from_left[a]).any(1)),
    ):
        at = np.searchsorted(keys, keys + step)
        a = np.flatnonzero(keys[np.minimum(at, n - 1)] == keys + step)
        links.append(np.stack([a, at[a]])[:, near(a, at[a])])
    a, b = np.concatenate(links, 1)
    inside = own[first]  # blocks are of one tile
    within = inside[a] & inside[b]
    label, x, y = np.arange(n), a[within], b[within]
    while (label[x] != label[y]).any():
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
    name = ((r[first].astype(np.int64) + REACH) << 32) + c[first] + 2 * REACH
    out = inside[a] & ~inside[b]
    a, b = a[out], b[out]
    return pd.DataFrame({
        "row": np.concatenate([r[own], r[first[b]]]), "col": np.concatenate([c[own], c[first[b]]]),
        "region": name[label[np.concatenate([block[own], a])]], "far": np.repeat([False, True], [own.sum(), len(a)]),
    })


def linked_cells(cells: DataFrame, bridge: int = 0, tile: int | None = None) -> DataFrame:
    """row, col, region: cells that touch, at corners too, are one region; those with up to twice
    `bridge` empty cells between them as well. cells: row, col. Regions are named after one of their cells.

    Cells are linked within tiles, in numpy, and each tile sees the blocks of other tiles that touch its own; only regions that
    meet across borders go through rounds of joins.
    """
    reach = 2 * bridge + 1
    tile = max(1, (tile or TILE) // reach) * reach
    keyed = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    back = lambda c: F.when(F.pmod(F.col(c), F.lit(tile)) < reach, -1).otherwise(0)
    on = F.when(F.pmod(F.col("col"), F.lit(tile)) >= tile - reach, 1).otherwise(0)
    seen = keyed.withColumn("dr", F.explode(F.sequence(back("row"), F.lit(0)))).withColumn("dc", F.explode(F.sequence(back("col"), on)))
    seen = seen.withColumn("own", (F.col("dr") == 0) & (F.col("dc") == 0))
    tiles = seen.groupBy((F.floor(F.col("row") / tile) + F.col("dr")).alias("tr"), (F.floor(F.col("col") / tile) + F.col("dc")).alias("tc"))
    found = saved(tiles.applyInPandas(lambda rows: _tile_links(rows, reach), "row long, col long, region long, far boolean"))
    local = found.where("not far").drop("far")
    met = found.where("far").select("row", "col", F.col("region").alias("a")).join(local.withColumnRenamed("region", "b"), ["row", "col"])
    edges = saved(met.select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    whole = components(nodes, edges).select(F.col("id").alias("region"), "component")
    return local.join(whole, "region", "left").select("row", "col", F.coalesce("component", "region").alias("region"))


def flat_points(points: DataFrame, cell: float = 0.25, max_above: float = 0.08, min_share: float = 0.3) -> DataFrame:
    """The points of the lowest surface: at most max_above over their cell's twentieth, in cells that hold at least min_share of the
    usual number of such points (three or more), and over which fewer than two points rise by 0.35 to 1 m."""
    keyed = placed(points, ("x", "y", "z")).withColumns({"__r": cell_of("y", cell), "__c": cell_of("x", cell)})
    order = Window.partitionBy("__r", "__c").orderBy("z", "point_id")
    ranks = keyed.select("__r", "__c", "z", F.row_number().over(order).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("__r", "__c")).alias("n"))
    floors = ranks.where(F.col("k") == F.floor(F.col("n") * 5 / 100) + 1).select("__r", "__c", F.col("z").alias("__floor"))
    keyed = keyed.join(floors, ["__r", "__c"]).withColumn("__up", F.col("z") - F.col("__floor"))
    low = F.col("__up") <= max_above
    cells = keyed.groupBy("__r", "__c").agg(F.count_if(low).alias("lows"), F.count_if(F.col("__up").between(0.35, 1.0)).alias("rising"))
    usual = cells.agg(F.percentile("lows", F.lit(0.5)).alias("usual"))
    road = cells.crossJoin(F.broadcast(usual)).where((F.col("lows") >= F.greatest(F.lit(3.0), min_share * F.col("usual"))) & (F.col("rising") < 2))  # one row
    return keyed.where(low).join(road.select("__r", "__c"), ["__r", "__c"], "left_semi").drop("__r", "__c", "__floor", "__up")


def without_specks(points: DataFrame, radius: float) -> DataFrame:
    """The points with at least two others, and at least 0.3 of the usual number of others, within a radius in plan."""
    near = pairs_within(points, points, radius, ("x", "y")).groupBy("a").agg((F.count(F.lit(1)) - 1).alias("others"))
    near = saved(near)
    usual = near.agg(F.percentile("others", F.lit(0.5)).alias("usual"))
    kept = near.crossJoin(F.broadcast(usual)).where(F.col("others") >= F.greatest(F.lit(2.0), 0.3 * F.col("usual")))  # one row
    return points.join(kept.select(F.col("a").alias("point_id")), "point_id", "left_semi")


def _described(pieces: DataFrame) -> DataFrame:
    """Facts of pieces (region, piece): points, middle, direction, the bend of a parabola along it, its extent and its width.

    Coordinates are along (t) and across (s) the direction of the largest spread. Width is between the 5 and 95 % points across the
    parabola, so a curved stripe keeps its own.
    """
    own = ["region", "piece"]
    m = pieces.groupBy(*own).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.min("point_id").alias("stripe"),
        F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"),
    )
    m = m.withColumn("angle", F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2).drop("xx", "yy", "xy")
    m = saved(m.withColumns({"dx": F.cos("angle"), "dy": F.sin("angle")}).drop("angle"))
    turned = saved(placed_along(pieces, m))
    t = F.col("t")
    powers = [F.avg(F.pow(t, F.lit(float(k)))).alias(f"t{k}") for k in (2, 3, 4)]
    q = turned.groupBy(*own).agg(*powers, F.avg(F.col("s") * t * t).alias("st2"), F.min("t").alias("low"), F.max("t").alias("high"))
    # least squares of s = a + b t + c t**2, where the means of t, s and s t are 0
    bottom = F.col("t2") * (F.col("t4") - F.col("t2") * F.col("t2")) - F.col("t3") * F.col("t3")
    bend = F.when(bottom > 1e-9 * F.pow("t2", F.lit(3.0)), F.col("t2") * F.col("st2") / bottom).otherwise(F.lit(0.0))
    q = q.withColumn("c", bend).withColumn("b", F.when(F.col("t2") > 0, -F.col("c") * F.col("t3") / F.col("t2")).otherwise(F.lit(0.0))).withColumn("a", -F.col("c") * F.col("t2"))
    q = saved(q.select(*own, "low", "high", "a", "b", "c"))
    off = F.col("s") - (F.col("a") + F.col("b") * t + F.col("c") * t * t)
    width = turned.select(*own, "t", "s").join(q, own).groupBy(*own).agg((F.percentile(off, F.lit(0.95)) - F.percentile(off, F.lit(0.05))).alias("width"))
    return m.join(q, own).join(width, own).withColumn("len", F.col("high") - F.col("low"))


def placed_along(pieces: DataFrame, facts: DataFrame) -> DataFrame:
    """pieces with t and s: places along and across the direction of their piece."""
    rows = pieces.join(facts.select("region", "piece", "mx", "my", "dx", "dy"), ["region", "piece"])
    x, y = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return rows.withColumns({"t": x * F.col("dx") + y * F.col("dy"), "s": y * F.col("dx") - x * F.col("dy")}).drop("mx", "my", "dx", "dy")


def pieces_of(points: DataFrame, cell: float, max_piece: float = 8.0) -> DataFrame:
    """point_id, x, y, z, region, piece: painted points by what hangs together (four empty cells are bridged), pieces longer than
    max_piece cut at their middle until none is."""
    keyed = saved(points.select("point_id", "x", "y", "z", cell_of("y", cell).alias("row"), cell_of("x", cell).alias("col")))
    whole = linked_cells(keyed.select("row", "col").distinct(), 2)
    left = saved(keyed.join(whole, ["row", "col"]).select("point_id", "x", "y", "z", "region", F.lit(1).cast("long").alias("piece")))
    done = None
    while True:
        m = left.groupBy("region", "piece").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
        angle = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
        along = placed_along(left, m.select("region", "piece", "mx", "my", F.cos(angle).alias("dx"), F.sin(angle).alias("dy")))
        long_ = along.groupBy("region", "piece").agg((F.max("t") - F.min("t") > max_piece).alias("long"))
        cut = saved(along.join(long_, ["region", "piece"]))
        short = cut.where("not long").select("point_id", "x", "y", "z", "region", "piece")
        done = short if done is None else done.unionByName(short)
        left = cut.where("long").select("point_id", "x", "y", "z", "region", (2 * F.col("piece") + (F.col("t") > 0).cast("long")).alias("piece"))
        if left.isEmpty():
            return done


def stripes(pieces: DataFrame, min_len: float = 1.0, max_width: float = 0.45) -> DataFrame:
    """The facts of pieces that are stripes: five points or more, length and width within bounds, 2.5 times longer than wide.
    `stripe` is the smallest point_id of each."""
    found = _described(pieces)
    return found.where((F.col("n") >= 5) & (F.col("len") >= min_len) & (F.col("width") <= max_width) & (F.col("len") >= 2.5 * F.col("width")))


def _mids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("stripe").alias("point_id"), F.col("mx").alias("x"), F.col("my").alias("y"))


def crossing_bars(found: DataFrame, max_angle: float = 10.0, min_sep: float = 0.5, max_sep: float = 1.8, max_len: float = 8.0, min_width: float = 0.2) -> DataFrame:
    """stripe: the bars of zebra crossings, which are short wide stripes with two like them side by side, and the neighbours of such."""
    bars = found.where((F.col("len") <= max_len) & (F.col("width") >= min_width)).select("stripe", "mx", "my", "dx", "dy", "len")
    near = pairs_within(_mids(bars), _mids(bars), max_sep + max_len / 2, ("x", "y")).where("a <> b").select("a", "b")
    for side in "ab":
        near = near.join(bars.select(F.col("stripe").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("mx", "my", "dx", "dy", "len")]), side)
    vx, vy = F.col("b_mx") - F.col("a_mx"), F.col("b_my") - F.col("a_my")
    like = F.greatest("a_len", "b_len") <= 2 * F.least("a_len", "b_len")
    parallel = F.abs(F.col("a_dx") * F.col("b_dx") + F.col("a_dy") * F.col("b_dy")) >= math.cos(math.radians(max_angle))
    beside = F.abs(vx * F.col("a_dy") - vy * F.col("a_dx")).between(min_sep, max_sep) & (F.abs(vx * F.col("a_dx") + vy * F.col("a_dy")) < (F.col("a_len") + F.col("b_len")) / 4)
    pairs = saved(near.where(like & parallel & beside).select("a", "b"))
    inner = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(F.col("a").alias("stripe"))
    return inner.unionByName(pairs.join(inner.withColumnRenamed("stripe", "a"), "a").select(F.col("b").alias("stripe"))).distinct()


def stop_pieces(found: DataFrame, min_width: float = 0.25, radius: float = 15.0) -> DataFrame:
    """stripe: wide stripes that run across the nearest thin one, by over 60 degrees, within a radius of their middles."""
    thin, wide = found.where(F.col("width") < min_width), found.where(F.col("width") >= min_width)
    near = pairs_within(_mids(wide), _mids(thin), radius, ("x", "y")).groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
    lane = thin.select(F.col("stripe").alias("b"), F.col("dx").alias("ex"), F.col("dy").alias("ey"))
    both = near.join(lane, "b").join(wide.select(F.col("stripe").alias("a"), "dx", "dy"), "a")
    return both.where(F.abs(F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey")) < 0.5).select(F.col("a").alias("stripe"))


def _ends(found: DataFrame) -> DataFrame:
    """id (twice the stripe, plus 1 at its far end), place x, y, z, the direction out of it ux, uy, stripe and width."""
    rows = []
    for far in (0, 1):
        t, sign = (F.col("high"), 1.0) if far else (F.col("low"), -1.0)
        s = F.col("a") + F.col("b") * t + F.col("c") * t * t
        slope = F.col("b") + 2 * F.col("c") * t
        size = F.sqrt(1 + slope * slope) * sign
        x, y = F.col("mx") + t * F.col("dx") - s * F.col("dy"), F.col("my") + t * F.col("dy") + s * F.col("dx")
        rows.append(F.struct(
            (2 * F.col("stripe") + far).alias("id"), x.alias("x"), y.alias("y"), F.col("mz").alias("z"),
            ((F.col("dx") - slope * F.col("dy")) / size).alias("ux"), ((F.col("dy") + slope * F.col("dx")) / size).alias("uy"), F.col("stripe").alias("stripe"), F.col("width").alias("width"),
        ))
    return found.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def _partners(ends: DataFrame, max_gap: float, max_angle: float, max_offset: float) -> DataFrame:
    """id, partner, gap: ends of different stripes that are each other's best continuation."""
    places = ends.select(F.col("id").alias("point_id"), "x", "y")
    near = pairs_within(places, places, max_gap + 0.5, ("x", "y")).where("a <> b")
    for side in "ab":
        near = near.join(ends.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}{c}") for c in ("x", "y", "ux", "uy", "stripe", "width")]), side)
    vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along = vx * F.col("aux") + vy * F.col("auy")
    across = F.abs(vy * F.col("aux") - vx * F.col("auy"))
    back = -(vx * F.col("bux") + vy * F.col("buy"))
    back_across = F.abs(vx * F.col("buy") - vy * F.col("bux"))
    ahead = F.greatest(along, F.lit(0.0))
    turn = F.cos(F.least(F.lit(math.pi / 3), math.radians(max_angle) + ahead / 50))  # the direction may turn on a radius of 50 m
    wide = lambda c: F.greatest(F.col(c), F.lit(0.1))
    good = (
        (F.col("astripe") != F.col("bstripe"))
        & along.between(-0.5, max_gap) & back.between(-0.5, max_gap)
        & (-(F.col("aux") * F.col("bux") + F.col("auy") * F.col("buy")) >= turn)
        & (F.greatest(across, back_across) <= max_offset + ahead * ahead / 100)
        & (F.greatest(wide("awidth"), wide("bwidth")) <= 2.5 * F.least(wide("awidth"), wide("bwidth")))
    )
    # the same number both ways, to the millionth, so that two ends can choose each other
    cost = F.round((along + back) / 2 + 5 * (across + back_across), 6)
    rows = near.where(good).select("a", "b", cost.alias("cost"), F.sqrt(vx * vx + vy * vy).alias("gap"))
    best = saved(rows.groupBy("a").agg(F.min_by(F.struct("b", "gap"), F.struct("cost", F.least("a", "b"), F.greatest("a", "b"))).alias("p")).select("a", "p.*"))
    mutual = best.join(best.select(F.col("a").alias("b"), F.col("b").alias("back")), "b").where("back = a")
    return mutual.select(F.col("a").alias("id"), F.col("b").alias("partner"), "gap")


def lines_of(found: DataFrame, max_gap: float = 12.0, max_angle: float = 10.0, max_offset: float = 0.35, solid_cover: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Lines of stripes (line, stripes, length, width, kind) and their vertices (line, seq, x, y, z, stripe).

    Ends of stripes are linked where each is the other's best continuation: least gap plus ten times the offset. A line is `solid` if
    gaps of over 1.5 m leave solid_cover of it painted, else `dashed`. Lines are named after their smallest stripe and run in its
    direction.
    """
    ends = saved(_ends(found))
    links = saved(_partners(ends, max_gap, max_angle, max_offset))
    # a way through a stripe is named after the end where it begins and leaves by the other end
    ways = ends.select("id", "stripe", F.col("id").bitwiseXOR(1).alias("out"))
    onward = links.select(F.col("id").alias("out"), F.col("partner").alias("nxt"), "gap")
    ways = saved(ways.join(onward, "out", "left"))
    chains = chained(ways.select("id", "nxt")).join(ways.select("id", "stripe", "gap"), "id")
    chains = saved(chains.withColumn("ending", F.col("cycle") & (F.col("left") == 0)))
    names = chains.groupBy("chain").agg(F.min("id").alias("first"), F.max("stripe").alias("top")).where("first % 2 = 0")
    kept = saved(chains.join(names.select("chain", (F.col("first") / 2).cast("long").alias("line")), "chain"))
    sizes = found.select("stripe", F.col("len").alias("len"), "width")
    gap = F.when(~F.col("ending"), F.col("gap"))
    facts = kept.join(sizes, "stripe").groupBy("line").agg(
        F.count(F.lit(1)).alias("stripes"), (F.sum("len") + F.coalesce(F.sum(gap), F.lit(0.0))).alias("length"),
        F.coalesce(F.sum(F.when(gap > 1.5, gap)), F.lit(0.0)).alias("bare"), F.percentile("width", F.lit(0.5)).alias("width"),
    )
    solid = F.col("length") - F.col("bare") >= solid_cover * F.col("length")
    facts = facts.select("line", "stripes", "length", "width", F.when(solid, "solid").otherwise("dashed").alias("kind"))
    most = kept.groupBy("line").agg(F.max("left").alias("most"))
    walked = kept.join(most, "line").select("line", "stripe", F.col("id").alias("enter"), (2 * (F.col("most") - F.col("left"))).alias("k"))
    steps = F.array(F.struct(F.col("enter").alias("id"), F.col("k").alias("seq")), F.struct(F.col("enter").bitwiseXOR(1).alias("id"), (F.col("k") + 1).alias("seq")))
    vertices = walked.select("line", F.explode(steps).alias("v")).select("line", "v.*").join(ends.select("id", "x", "y", "z", "stripe"), "id")
    return facts, vertices.select("line", "seq", "x", "y", "z", "stripe")


def extract_markings(
    painted: DataFrame, cell: float = 0.1, min_len: float = 1.0, max_width: float = 0.45, max_gap: float = 12.0, max_angle: float = 10.0,
    max_offset: float = 0.35, min_line: float = 5.0, solid_cover: float = 0.75, min_stop: float = 1.5,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines (line, stripes, length, width, kind: solid, dashed or stop), their vertices (line, seq, x, y, z, stripe), and what each
    painted point is part of (point_id, kind: line, stop or other).

    painted: point_id, x, y, z, such as `ground.marking_candidates` of `flat_points` without specks. point_id is a whole number below
    2**62. Rows without finite coordinates take no part; a repeated row counts like another point; no rows give no lines. A piece
    that is no stripe, the bars of crossings, and lines shorter than min_line (stop lines: min_stop) are `other`. Marks that touch
    each other are one piece: they are cut by length, not by which mark their points are of.
    """
    held = saved(placed(painted.select("point_id", "x", "y", "z"), ("x", "y", "z")))
    pieces = saved(pieces_of(held, cell))
    every = saved(stripes(pieces, min_len, max_width))
    found = saved(every.join(crossing_bars(every, max_angle), "stripe", "left_anti"))
    stops = saved(stop_pieces(found))
    results = []
    for part, settings, least, kind in (
        (found.join(stops, "stripe", "left_anti"), (max_gap, max_angle, max_offset), min_line, None),
        (found.join(stops, "stripe", "left_semi"), (1.5, 15.0, 0.3), min_stop, "stop"),
    ):
        facts, vertices = lines_of(saved(part), *settings, solid_cover)
        facts = facts.where(F.col("length") >= least)
        results.append((facts.withColumn("kind", F.lit(kind)) if kind else facts, vertices))
    facts = saved(results[0][0].unionByName(results[1][0]))
    vertices = results[0][1].unionByName(results[1][1]).join(facts.select("line"), "line", "left_semi")
    role = F.when(F.col("kind") == "stop", F.lit("stop")).otherwise(F.lit("line"))
    of = vertices.select("line", "stripe").distinct().join(facts.select("line", role.alias("kind")), "line").join(every.select("stripe", "region", "piece"), "stripe")
    members = pieces.join(of.select("region", "piece", "kind"), ["region", "piece"], "left").select("point_id", F.coalesce("kind", F.lit("other")).alias("kind"))
    return facts, vertices, members


def _spread(c: str) -> Column:
    return F.max(c) - F.min(c)


def extract_poles(points: DataFrame, ground: DataFrame, cell: float = 0.25, min_height: float = 2.5, max_diameter: float = 0.6, min_height_above: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Thin upright columns (pole, x, y, z_ground, height, points) and the points of each (point_id, pole).

    points and ground: point_id, x, y, z. Points at least min_height_above over the lowest ground of cells of 0.5 m hang together in
    cells that touch. A column has ten points, reaches min_height, is no wider than max_diameter and a cell, and has points in 0.6 of
    its steps of 0.25 m. A pole is named after its smallest point_id. Points over no ground, or without finite coordinates, take no part.
    """
    axes = ("x", "y", "z")
    lowest = placed(ground, axes).groupBy(cell_of("y", 0.5).alias("row"), cell_of("x", 0.5).alias("col")).agg(F.min("z").alias("z"))
    above = surface_at(placed(points.select("point_id", *axes), axes), lowest, 0.5, fallback=True).where("ref IS NOT NULL")
    above = above.select("point_id", *axes, (F.col("z") - F.col("ref")).alias("h")).where(F.col("h") >= min_height_above)
    keyed = saved(above.withColumns({"row": cell_of("y", cell), "col": cell_of("x", cell)}))
    placed_in = saved(keyed.join(linked_cells(keyed.select("row", "col").distinct()), ["row", "col"]))
    facts = placed_in.groupBy("region").agg(
        F.count(F.lit(1)).alias("points"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.percentile(F.col("z") - F.col("h"), F.lit(0.5)).alias("z_ground"), F.max("h").alias("height"),
        F.greatest(_spread("x"), _spread("y")).alias("wide"), F.count_distinct(F.floor(F.col("h") / 0.25)).alias("steps"), F.min("point_id").alias("pole"),
    )
    thin = (F.col("points") >= 10) & (F.col("wide") <= max_diameter + cell) & (F.col("height") >= min_height)
    poles = saved(facts.where(thin & (F.col("steps") >= 0.6 * F.ceil(F.col("height") / 0.25))))
    members = placed_in.join(poles.select("region", "pole"), "region").select("point_id", "pole")
    return poles.select("pole", "x", "y", "z_ground", "height", "points"), members
