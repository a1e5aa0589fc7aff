"""Linear referencing and route analyses: chainage, stations, runs, cover, spans and re-burial.

Routes are rows (route_id, seq, ...); order is always an explicit column. Everything is a window over route_id or an aggregate
on (route_id, run). Interpolation is an as-of step: stations and vertices are put in one order by a union and a window carries
the last and the next vertex, so no range join is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: tolerance of thresholds, in metres.
EPS = 1e-4


def with_chainage(vertices: DataFrame) -> DataFrame:
    """Adds cum, the distance along the route."""
    w = Window.partitionBy("route_id").orderBy("seq")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    stepped = vertices.withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return stepped.withColumn("cum", F.sum("step").over(w)).drop("step")


def interpolate(at: DataFrame, known: DataFrame, on: str, values: tuple[str, ...], clamp: bool = True, max_gap: float | None = None) -> DataFrame:
    """at (route_id, key, on) with the known rows' values, linear between the rows on either side.

    Beyond the ends the end's value holds with clamp, else there is none; nor is there one between rows more than max_gap apart.
    """
    packed = F.struct(F.col(on).alias("at"), *[F.col(v).alias(v) for v in values])
    rows = known.select("route_id", F.col(on).alias("__o"), F.lit(0).alias("__q"), F.lit(None).cast(at.schema["key"].dataType).alias("key"), packed.alias("__p"))
    asked = at.select("route_id", F.col(on).alias("__o"), F.lit(1).alias("__q"), "key", F.lit(None).cast(rows.schema["__p"].dataType).alias("__p"))
    both = rows.unionByName(asked)
    order = Window.partitionBy("route_id").orderBy("__o", "__q")
    before = F.last("__p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__p", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = both.select("route_id", "__o", "__q", "key", before.alias("a"), after.alias("b")).where("__q = 1")
    span = F.col("b.at") - F.col("a.at")
    near = F.lit(True) if max_gap is None else F.coalesce(span <= max_gap, F.lit(True))

    def value(v: str) -> Column:
        inside = F.when(span > 0, F.col(f"a.{v}") + (F.col(f"b.{v}") - F.col(f"a.{v}")) * (F.col("__o") - F.col("a.at")) / span).otherwise(F.col(f"a.{v}"))
        ends = F.coalesce(F.col(f"a.{v}"), F.col(f"b.{v}")) if clamp else F.when(F.col("a.at") == F.col("__o"), F.col(f"a.{v}"))
        return F.when(near, F.when(F.col("a").isNull() | F.col("b").isNull(), ends).otherwise(inside)).alias(v)

    return both.select("route_id", "key", F.col("__o").alias(on), *[value(v) for v in values])


def stations(vertices: DataFrame, step: float = 1.0) -> DataFrame:
    """route_id, station, ch: every `step` metres, and the end if more than 1e-6 is left."""
    ends = vertices.groupBy("route_id").agg(F.max("cum").alias("length"))
    n = F.floor(F.col("length") / step + 1e-9)
    rest = F.when(F.col("length") - n * step > 1e-6, F.array(F.col("length"))).otherwise(F.array().cast("array<double>"))
    places = F.concat(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: i * step), rest)
    return ends.select("route_id", F.posexplode(places).alias("station", "ch"))


def xy_at(vertices: DataFrame, places: DataFrame) -> DataFrame:
    """places (route_id, key, cum) with x and y."""
    return interpolate(places, vertices, "cum", ("x", "y"))


def half_way_edges(rows: DataFrame, ch: str = "ch") -> DataFrame:
    """Adds lo and hi, half way to the stations before and after; end stations have half a cell."""
    w = Window.partitionBy("route_id").orderBy(ch)
    lo = F.coalesce((F.lag(ch).over(w) + F.col(ch)) / 2, F.col(ch))
    hi = F.coalesce((F.lead(ch).over(w) + F.col(ch)) / 2, F.col(ch))
    return rows.withColumns({"lo": lo, "hi": hi})


def with_runs(rows: DataFrame, mask: Column, order: tuple[str, ...] = ("ch",)) -> DataFrame:
    """Adds flag and run: a number that rows of one stretch of equal flags share."""
    w = Window.partitionBy("route_id").orderBy(*order)
    flagged = rows.withColumn("flag", F.coalesce(mask, F.lit(False)))
    turn = F.coalesce((F.col("flag") != F.lag("flag").over(w)).cast("int"), F.lit(1))
    return flagged.withColumn("run", turn).withColumn("run", F.sum("run").over(w))


def segments(rows: DataFrame, mask: Column, value: str = "z", most: bool = False) -> DataFrame:
    """A row per run where the mask holds: start, end, length by half-way cells, count, mean, and the extreme value with the
    first place where it is reached."""
    edged = with_runs(half_way_edges(rows), mask).where("flag")
    order = F.struct(-F.col(value) if most else F.col(value), F.col("ch"))
    return edged.groupBy("route_id", "run").agg(
        F.min("lo").alias("ch_from"),
        F.max("hi").alias("ch_to"),
        F.sum(F.col("hi") - F.col("lo")).alias("length"),
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.min_by(F.struct(F.col(value).alias("v"), F.col("ch").alias("c")), order).alias("e"),
    ).select("route_id", "ch_from", "ch_to", "length", "n", "mean", F.col("e.v").alias("extreme"), F.col("e.c").alias("extreme_ch"))


def long_segments(found: DataFrame, min_len: float) -> DataFrame:
    return found.where(F.col("length") >= min_len - 1e-9)


def merge_gaps(found: DataFrame, merge_gap: float) -> DataFrame:
    """Joins segments of a route whose gap is at most merge_gap."""
    w = Window.partitionBy("route_id").orderBy("ch_from")
    apart = F.coalesce((F.col("ch_from") - F.lag("ch_to").over(w) > merge_gap).cast("int"), F.lit(1))
    grouped = found.withColumn("g", apart).withColumn("g", F.sum("g").over(w))
    return grouped.groupBy("route_id", "g").agg(F.min("ch_from").alias("ch_from"), F.max("ch_to").alias("ch_to"), F.count(F.lit(1)).alias("parts")).drop("g")


def chainage_bins(rows: DataFrame, bin_m: float, value: str = "z", ok: Column | None = None) -> DataFrame:
    """Per route and bin: length, least, mean and greatest value, and the share of the length that is ok."""
    edged = half_way_edges(rows).withColumn("bin", F.floor(F.col("ch") / bin_m + 1e-9).cast("long"))
    length = F.col("hi") - F.col("lo")
    share = F.sum(F.when(ok, length).otherwise(0.0)) / F.sum(length) * 100 if ok is not None else F.lit(None).cast("double")
    return edged.groupBy("route_id", "bin").agg(
        F.sum(length).alias("length"),
        F.min(value).alias("least"),
        F.avg(value).alias("mean"),
        F.max(value).alias("most"),
        F.when(F.sum(length) > 0, share).alias("ok_pct"),
    )


def cover(stationed: DataFrame, target: float) -> DataFrame:
    """Per route: lengths that are covered to the target, below it, and exposed. stationed: route_id, ch, seabed, top."""
    dob = F.col("seabed") - F.col("top")
    rows = half_way_edges(stationed.withColumn("dob", dob).where(dob.isNotNull()))
    length = F.col("hi") - F.col("lo")
    part = lambda mask: F.sum(F.when(mask, length).otherwise(0.0))
    return rows.groupBy("route_id").agg(
        F.min("dob").alias("least"),
        F.avg("dob").alias("mean"),
        part(F.col("dob") >= target - EPS).alias("compliant_m"),
        part((F.col("dob") < target - EPS) & (F.col("dob") > EPS)).alias("below_m"),
        part(F.col("dob") <= EPS).alias("exposed_m"),
    )


def spans(stationed: DataFrame, diameter: float = 0.2, gap_min: float = 0.1, len_min: float = 10.0) -> DataFrame:
    """Stretches where the cable hangs: gap = (top - diameter) - seabed over gap_min; SPAN if len_min long, else SHORT."""
    rows = stationed.withColumn("gap", F.col("top") - diameter - F.col("seabed"))
    found = segments(rows, F.col("gap") > gap_min + EPS, "gap", most=True)
    return found.withColumn("kind", F.when(F.col("length") >= len_min - 1e-9, F.lit("SPAN")).otherwise(F.lit("SHORT")))


def peak_shave(rows: DataFrame, slope: float) -> DataFrame:
    """Lowers z until no step is steeper than `slope` (rise over run): the lower envelope of both directions, exact in two passes."""
    w = Window.partitionBy("route_id").orderBy("ch", "point_id")
    forward = F.min(F.col("z") - slope * F.col("ch")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + slope * F.col("ch")
    back = F.min(F.col("z") + slope * F.col("ch")).over(w.rowsBetween(0, Window.unboundedFollowing)) - slope * F.col("ch")
    return rows.withColumn("shaved", F.least("z", forward, back))


def moving_mean(rows: DataFrame, reach: int) -> DataFrame:
    """Long wave: the mean over 2 * reach + 1 rows, ends repeated; and what is left, the bedform."""
    w = Window.partitionBy("route_id").orderBy("ch", "point_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, n = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    low, high = F.greatest(F.lit(0), F.lit(reach + 1) - place), F.greatest(F.lit(0), place + reach - n)
    inner = F.sum("z").over(w.rowsBetween(-reach, reach))
    total = inner + low * F.first("z").over(whole) + high * F.last("z").over(whole)
    out = rows.withColumn("long_wave", total / (2 * reach + 1))
    return out.withColumn("bedform", F.col("z") - F.col("long_wave"))


def lag_correlation(a: DataFrame, b: DataFrame, max_lag: int) -> DataFrame:
    """lag and r for lags -max_lag to max_lag of two series (i, v); r is the correlation of a's rows with b's shifted ones."""
    shifted = a.select("i", F.col("v").alias("va"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"))
    pairs = shifted.withColumn("j", F.col("i") + F.col("lag")).join(b.select(F.col("i").alias("j"), F.col("v").alias("vb")), "j")
    return pairs.groupBy("lag").agg(F.corr("va", "vb").alias("r"), F.count(F.lit(1)).alias("n"))


def mass_haul(rows: DataFrame, cut_to_fill: float = 0.9) -> DataFrame:
    """Running sum of cut * cut_to_fill - fill along each route. rows: route_id, bin, cut, fill."""
    w = Window.partitionBy("route_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("haul", F.sum(F.col("cut") * cut_to_fill - F.col("fill")).over(w))


def reburial_years(stationed: DataFrame, required: float, merge_gap: float, min_len: float = 0.0) -> DataFrame:
    """Per route and year: stretches with less cover than required. stationed: route_id, year, ch, dob; years are independent."""
    keyed = stationed.withColumn("route_id", F.struct("route_id", "year"))
    found = long_segments(segments(keyed, F.col("dob") < required - EPS, "dob"), min_len)
    merged = merge_gaps(found, merge_gap)
    return merged.select("route_id.route_id", "route_id.year", "ch_from", "ch_to", "parts")


def reburial_campaigns(stationed: DataFrame, required: float, restored: float) -> DataFrame:
    """The years in which a station must be buried again, when burial restores the cover and it is lost from there as before.

    stationed: route_id, ch, year, dob without any burial. Cumulative: the state of a station is folded over its years.
    """
    years = F.sort_array(F.collect_list(F.struct("year", "dob")))
    per = stationed.groupBy("route_id", "ch").agg(years.alias("ys"))
    start = F.struct(F.lit(0.0).alias("added"), F.array().cast("array<int>").alias("campaigns"))

    def fold(s: Column, y: Column) -> Column:
        low = y["dob"] + s["added"] < required - EPS
        return F.struct(
            F.when(low, restored - y["dob"]).otherwise(s["added"]).alias("added"),
            F.when(low, F.concat(s["campaigns"], F.array(y["year"].cast("int")))).otherwise(s["campaigns"]).alias("campaigns"),
        )

    return per.select("route_id", "ch", F.aggregate("ys", start, fold)["campaigns"].alias("campaigns"))


def years_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a) / 365.25


def clearance(points: DataFrame, line: list[tuple[float, float, float]], limit: float, bin_m: float) -> DataFrame:
    """Runs of adjacent bins along a 3-D line with points nearer than limit: bins, count, least distance and where, modal class."""
    parts, cum = [], 0.0
    for (x1, y1, z1), (x2, y2, z2) in zip(line, line[1:]):
        d = (x2 - x1, y2 - y1, z2 - z1)
        length = sum(c * c for c in d) ** 0.5
        u = [c / length for c in d]
        p = [F.col(c) - v for c, v in zip(("x", "y", "z"), (x1, y1, z1))]
        t = F.least(F.lit(length), F.greatest(F.lit(0.0), p[0] * u[0] + p[1] * u[1] + p[2] * u[2]))
        dist = F.sqrt(sum(F.pow(a - t * b, 2) for a, b in zip(p, u)))
        parts.append(F.struct(dist.alias("d"), (t + cum).alias("ch")))
        cum += length
    near = points.withColumn("hit", F.array_min(F.array(*parts))).where(F.col("hit.d") < limit)
    near = near.select("point_id", "classification", F.col("hit.d").alias("d"), F.floor(F.col("hit.ch") / bin_m).alias("bin"))
    per_class = near.groupBy("bin", "classification").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "point_id")).alias("near"))
    bins = per_class.select("bin").distinct()
    runs = bins.withColumn("run", F.col("bin") - F.row_number().over(Window.orderBy("bin")))  # a row per bin of one line
    per_run = per_class.join(runs, "bin").groupBy("run", "classification").agg(F.sum("n").alias("n"), F.min("bin").alias("b1"), F.max("bin").alias("b2"), F.min("near").alias("near"))
    return per_run.groupBy("run").agg(
        F.min("b1").alias("bin_from"),
        F.max("b2").alias("bin_to"),
        F.sum("n").alias("n"),
        F.min("near")["d"].alias("least"),
        F.min("near")["point_id"].alias("point_id"),
        F.max_by("classification", F.struct("n", -F.col("classification"))).alias("modal_class"),
    ).drop("run")


def crest_and_sides(points: DataFrame, stationed: DataFrame, search: float, side: float) -> DataFrame:
    """Per station: the highest z within `search` of it and the mean of the medians on both sides up to `side`.

    points: route_id, ch, off, z (in the route's corridor); stationed: route_id, station, lo, hi.
    """
    near = points.join(stationed, "route_id").where((F.col("ch") >= F.col("lo")) & (F.col("ch") < F.col("hi")) & (F.abs("off") <= side))
    mid = lambda mask: F.percentile(F.when(mask, F.col("z")), F.lit(0.5))
    return near.groupBy("route_id", "station").agg(
        F.max(F.when(F.abs("off") <= search, F.col("z"))).alias("crest"),
        ((mid(F.col("off") < -search) + mid(F.col("off") > search)) / 2).alias("seabed"),
    )


def with_kp(vertices: DataFrame, start_kp: float = 0.0) -> DataFrame:
    """vertices with kp in kilometres: their own where they have one, else the start's and the distance along the route."""
    along = start_kp + F.col("cum") / 1000
    return vertices.withColumn("kp", F.coalesce("kp", along) if "kp" in vertices.columns else along)


def kp_range(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("route_id").agg(F.min("kp").alias("kp_from"), F.max("kp").alias("kp_to"))


def chainage_range(vertices: DataFrame, kp_from: float, kp_to: float) -> DataFrame:
    """route_id, ch_from, ch_to of the routes that a range of kp overlaps, clipped to each. vertices: cum and kp."""
    low, high = sorted((kp_from, kp_to))
    if high - low < 1e-9:
        raise ValueError("a range of kp needs a length")
    ends = vertices.groupBy("route_id").agg(F.min("kp").alias("k0"), F.max("kp").alias("k1"), F.max("cum").alias("length"))
    there = ends.where((F.lit(high) >= F.col("k0") - 1e-9) & (F.lit(low) <= F.col("k1") + 1e-9))
    asked = there.select("route_id", F.posexplode(F.array(F.lit(low), F.lit(high))).alias("key", "kp"))
    found = interpolate(asked, vertices.join(there.select("route_id"), "route_id", "left_semi"), "kp", ("cum",))
    both = found.groupBy("route_id").agg(F.min("cum").alias("a"), F.max("cum").alias("b"))
    return both.join(there, "route_id").select("route_id", F.greatest(F.lit(0.0), "a").alias("ch_from"), F.least("length", "b").alias("ch_to"))


def directions(vertices: DataFrame) -> DataFrame:
    """route_id, seq, ux, uy: the unit direction of the segment that each vertex but the last begins."""
    w = Window.partitionBy("route_id").orderBy("seq")
    dx, dy = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    size = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-12))
    return vertices.select("route_id", "seq", (dx / size).alias("ux"), (dy / size).alias("uy")).where("ux is not null")


def stretches(stationed: DataFrame, target: float) -> DataFrame:
    """route_id, type, ch_from, ch_to, length, worst, ch_worst: where the cable is exposed, and where its cover is below the target.

    stationed: route_id, ch, seabed, top.
    """
    rows = stationed.withColumn("dob", F.col("seabed") - F.col("top")).where("dob is not null")
    kinds = (("Exposed", F.col("dob") <= EPS), ("Below target", F.col("dob") < target - EPS))
    out = None
    for name, mask in kinds:
        part = segments(rows, mask, "dob").select("route_id", F.lit(name).alias("type"), "ch_from", "ch_to", "length", F.col("extreme").alias("worst"), F.col("extreme_ch").alias("ch_worst"))
        out = part if out is None else out.union(part)
    return out


def burial_summary(stationed: DataFrame, target: float) -> DataFrame:
    """A report's row per route: surveyed length and share, share that meets the target, lengths below it and exposed, least
    cover and where, mean cover. stationed: route_id, ch, seabed, top; stations without one of the levels weren't surveyed."""
    rows = half_way_edges(stationed.withColumn("dob", F.col("seabed") - F.col("top")))
    length = F.col("hi") - F.col("lo")
    part = lambda mask: F.sum(F.when(mask, length).otherwise(0.0))
    known = F.col("dob").isNotNull()
    out = rows.groupBy("route_id").agg(
        F.sum(length).alias("length"),
        part(known).alias("surveyed"),
        part(F.col("dob") >= target - EPS).alias("compliant"),
        part((F.col("dob") < target - EPS) & (F.col("dob") > EPS)).alias("below"),
        part(F.col("dob") <= EPS).alias("exposed"),
        F.min_by(F.struct("dob", "ch"), F.when(known, F.struct("dob", "ch"))).alias("least"),
        F.avg("dob").alias("dob_mean"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100)
    return out.select(
        "route_id", "length", share("surveyed", "length").alias("coverage_pct"), share("compliant", "surveyed").alias("compliant_pct"), "below", "exposed",
        F.col("least.dob").alias("dob_min"), F.col("least.ch").alias("ch_min"), "dob_mean",
    )


def burial_report(stationed: DataFrame, target: float, bin_m: float) -> dict[str, DataFrame]:
    """The sheets of a burial report: Summary, Stretches and Bins."""
    rows = stationed.withColumn("dob", F.col("seabed") - F.col("top"))
    bins = chainage_bins(rows.where("dob is not null"), bin_m, "dob", F.col("dob") >= target - EPS)
    return {"Summary": burial_summary(stationed, target), "Stretches": stretches(stationed, target), "Bins": bins}


def kp_unit(vertices: DataFrame) -> DataFrame:
    """unit: `m` if kp rises by metres along the routes, for half of all steps within a twentieth, else `km`; one row."""
    w = Window.partitionBy("route_id").orderBy("seq")
    dx, dy, dk = (F.col(c) - F.lag(c).over(w) for c in ("x", "y", "kp"))
    steps = vertices.select(F.sqrt(dx * dx + dy * dy).alias("d"), dk.alias("dk")).where("d > 0")
    off = F.percentile(F.abs(F.col("dk") - F.col("d")) / F.col("d"), F.lit(0.5))
    return steps.agg(F.when(off < 0.05, "m").otherwise("km").alias("unit"))


def reprojected(rows: DataFrame, src: int, dst: int) -> DataFrame:
    """rows with x and y in another coordinate system."""
    from bathyal.functions.crs import transform

    x, y = transform(F.col("x"), F.col("y"), src, dst)
    return rows.withColumns({"x": x, "y": y})


def multiyear_table(stationed: DataFrame, required: float) -> DataFrame:
    """Per route and year: lengths with less cover than required and exposed, least cover. stationed: route_id, year, ch, dob."""
    w = Window.partitionBy("route_id", "year").orderBy("ch")
    lo = F.coalesce((F.lag("ch").over(w) + F.col("ch")) / 2, F.col("ch"))
    hi = F.coalesce((F.lead("ch").over(w) + F.col("ch")) / 2, F.col("ch"))
    rows = stationed.withColumn("step", hi - lo)
    part = lambda mask: F.sum(F.when(mask, F.col("step")).otherwise(0.0))
    return rows.groupBy("route_id", "year").agg(
        F.sum("step").alias("length"), part(F.col("dob") < required - EPS).alias("below_m"), part(F.col("dob") <= EPS).alias("exposed_m"), F.min("dob").alias("dob_min")
    )


def multiyear_summary(table: DataFrame) -> DataFrame:
    """Per route: length, years, the first with too little cover and with exposure, and the worst one with its length."""
    first = lambda c: F.min(F.when(F.col(c) > 0, F.col("year")))
    return table.groupBy("route_id").agg(
        F.max("length").alias("length"),
        F.concat_ws("-", F.min("year").cast("string"), F.max("year").cast("string")).alias("years"),
        first("below_m").alias("first_reburial"),
        first("exposed_m").alias("first_exposed"),
        F.max_by("year", F.struct("below_m", -F.col("year"))).alias("worst_year"),
        F.max("below_m").alias("worst_m"),
    )


def multiyear_batch(stationed: DataFrame, required: float, restored: float, merge_gap: float, min_len: float = 0.0) -> dict[str, DataFrame]:
    """The sheets of a batch of routes: Summary, Years, Segments and Campaigns. A batch is one table; routes are told apart by id."""
    years = multiyear_table(stationed, required)
    return {
        "Summary": multiyear_summary(years),
        "Years": years,
        "Segments": reburial_years(stationed, required, merge_gap, min_len),
        "Campaigns": reburial_campaigns(stationed, required, restored),
    }
