"""Design surfaces along a route and in a polygon, and migration of bedforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bathyal.functions.expressions import in_polygon, segment_offsets


def route_offsets(surface: DataFrame, cell: float, line: Sequence[tuple[float, float]], reach: float) -> DataFrame:
    """surface's cells within reach of a route, with chainage and signed offset of their centres."""
    at = segment_offsets((F.col("col") + 0.5) * cell, (F.col("row") + 0.5) * cell, line)
    return surface.withColumn("h", at).where(F.col("h.dist") <= reach).select("row", "col", "z", F.col("h.ch").alias("ch"), F.col("h.off").alias("off"), F.col("h.dist").alias("dist"))


def seabed_profile(near: DataFrame, step: float, half_width: float, smooth: float = 0.0) -> DataFrame:
    """station and level: the mean of cells near the route per step of chainage, smoothed over a running window."""
    rows = near.where(F.abs("off") <= half_width).groupBy(F.floor(F.col("ch") / step).alias("station")).agg(F.avg("z").alias("level"))
    reach = int(smooth / step / 2)
    return rows.withColumn("level", F.avg("level").over(Window.orderBy("station").rowsBetween(-reach, reach))) if reach else rows  # a row per station of one route


def trench(near: DataFrame, profile: DataFrame, step: float, cell: float, bottom: float, depth: float, slope: float, bin_m: float) -> DataFrame:
    """Per bin of chainage: what is dug for a trench whose bottom lies `depth` under the profile, with sides 1:slope."""
    rows = near.withColumn("station", F.floor(F.col("ch") / step)).join(profile, "station")
    floor = F.col("level") - depth + F.greatest(F.lit(0.0), F.col("dist") - bottom / 2) / slope
    cut = F.greatest(F.lit(0.0), F.col("z") - floor)
    return rows.groupBy(F.floor(F.col("ch") / bin_m).alias("bin")).agg((F.sum(cut) * cell * cell).alias("volume"), (F.sum((cut > 1e-9).cast("int")) * cell * cell).alias("area"))


def berm(near: DataFrame, profile: DataFrame, step: float, crest: float, height: float, slope: float) -> DataFrame:
    """row, col, z, ch, off of a berm on the profile: a crest and sides 1:slope, where it rises over the bed by 0.05 m."""
    rows = near.withColumn("station", F.floor(F.col("ch") / step)).join(profile, "station")
    top = F.col("level") + height - F.greatest(F.lit(0.0), F.abs("off") - crest / 2) / slope
    return rows.withColumns({"bed": F.col("z"), "z": top}).where(F.col("z") > F.col("bed") + 0.05).select("row", "col", "z", "ch", "off", "bed")


def berm_check(design: DataFrame, built: DataFrame, cell: float, bin_m: float, tol: float = 0.1) -> DataFrame:
    """Per bin: volume and area over and under the design beyond the tolerance, and the share of the design that was surveyed."""
    both = design.join(built.select("row", "col", F.col("z").alias("built")), ["row", "col"], "left").withColumn("d", F.col("built") - F.col("z"))
    part = lambda mask, v: F.sum(F.when(mask, v).otherwise(0.0)) * cell * cell
    return both.groupBy(F.floor(F.col("ch") / bin_m).alias("bin")).agg(
        part(F.col("d") > tol, F.col("d")).alias("over"),
        part(F.col("d") < -tol, -F.col("d")).alias("under"),
        part(F.col("d") < -tol, F.lit(1.0)).alias("under_area"),
        F.avg(F.col("built").isNotNull().cast("double")).alias("surveyed"),
    )


def side_slopes(surface: DataFrame, cell: float, ring: Sequence[tuple[float, float]], level: float, cut: float, fill: float) -> DataFrame:
    """row, col, z, design of dredging to a level in a polygon with sides 1:cut up and 1:fill down outside of it."""
    x, y = (F.col("col") + 0.5) * cell, (F.col("row") + 0.5) * cell
    closed = [*ring, ring[0]]
    away = F.when(in_polygon(x, y, ring), F.lit(0.0)).otherwise(segment_offsets(x, y, closed)["dist"])
    z = F.col("z")
    target = F.when(z > level, F.least(z, level + away / cut)).otherwise(F.greatest(z, level - away / fill))
    return surface.select("row", "col", "z", target.alias("design"))


def road_formation(near: DataFrame, grade: DataFrame, step: float, half_width: float, crossfall: float, cut: float, fill: float, bin_m: float, cell: float) -> DataFrame:
    """Per bin: cut and fill of a road with crossfall (percent) on a grade line (station, level), and side slopes."""
    rows = near.withColumn("station", F.floor(F.col("ch") / step)).join(grade, "station")
    edge = F.col("level") - half_width * crossfall / 100
    beyond = F.greatest(F.lit(0.0), F.abs("off") - half_width)
    road = F.col("level") - F.abs("off") * crossfall / 100
    side = F.when(F.col("z") > edge, F.least("z", edge + beyond / cut)).otherwise(F.greatest("z", edge - beyond / fill))
    d = F.when(beyond > 0, side).otherwise(road) - F.col("z")
    area = cell * cell
    return rows.groupBy(F.floor(F.col("ch") / bin_m).alias("bin")).agg((F.sum(F.greatest(-d, F.lit(0.0))) * area).alias("cut"), (F.sum(F.greatest(d, F.lit(0.0))) * area).alias("fill"))


def migration(a: DataFrame, b: DataFrame, step: float, window: int, max_lag: int, years: float, least: float = 0.6) -> DataFrame:
    """Per window of stations: the shift from bedform a to b (station, v) with the best correlation, refined by a parabola, and
    its rate; windows whose correlation is under `least` are unreliable."""
    lags = F.sequence(F.lit(-max_lag), F.lit(max_lag))
    pairs = a.select("station", F.col("v").alias("va"), F.explode(lags).alias("lag")).withColumn("s2", F.col("station") + F.col("lag"))
    pairs = pairs.join(b.select(F.col("station").alias("s2"), F.col("v").alias("vb")), "s2")
    r = pairs.groupBy(F.floor(F.col("station") / window).alias("window"), "lag").agg(F.corr("va", "vb").alias("r")).where("r is not null and not isnan(r)")
    w = Window.partitionBy("window").orderBy("lag")
    r = r.withColumns({"before": F.lag("r").over(w), "after": F.lead("r").over(w)})
    best = r.groupBy("window").agg(F.max_by(F.struct("lag", "r", "before", "after"), F.struct("r", -F.abs("lag"))).alias("m")).select("window", "m.*")
    bend = F.col("before") - 2 * F.col("r") + F.col("after")
    sub = F.coalesce(F.when(bend < 0, (F.col("before") - F.col("after")) / (2 * bend)), F.lit(0.0))
    shift = (F.col("lag") + sub) * step
    return best.select("window", shift.alias("shift"), (shift / years).alias("rate"), "r", (F.col("r") >= least).alias("reliable"))


def circular_median(azimuth: Column) -> Column:
    """The direction of the medians of sine and cosine, in degrees."""
    rad = F.radians(azimuth)
    mid = lambda c: F.percentile(c, F.lit(0.5))
    return F.pmod(F.degrees(F.atan2(mid(F.sin(rad)), mid(F.cos(rad)))), F.lit(360.0))
