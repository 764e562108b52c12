"""Building a feed from route lines: stops, run times, windows and trips.

``lines``: one row a route with route_id, points array<struct<lat, lon>> and
the attributes of the layer.  All steps are expressions, windows and equi- or
range joins over points and stops, so thousands of routes are built at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..feed import ROW, Feed
from ..functions import geo, times
from ..spec import WEEKDAYS
from . import edit

# Route types of mode names, and defaults of the layer's columns.
MODE_TYPES = {"tram": 0, "subway": 1, "rail": 2, "bus": 3, "ferry": 4}
DEFAULT_DAYS, FIRST_DEPARTURE, LAST_DEPARTURE, SPEED_KMH = "daily", "06:00:00", "22:00:00", 25.0
# Short names that a layer may use for long ones.
ALIASES = {"route_short_name": "short_name", "headway_min": "headway", "first_departure": "first_dep", "last_departure": "last_dep", "bidirectional": "bidir", "duration_min": "duration"}
MOST = 10_000


def attribute(lines: DataFrame, name: str, default: Column | str | float | None = None) -> Column:
    """The attribute as text under its name or alias; blanks count as absent."""
    own = [F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))) for c in (name, ALIASES.get(name, name)) if c in lines.columns]
    last = [default if isinstance(default, Column) else F.lit(default).cast("string")]
    return F.coalesce(*own, *last)


def require(rows: DataFrame, bad: Column, what: str) -> None:
    """An error naming the first route, by id, for which ``bad`` holds."""
    hit = rows.where(bad).agg(F.min("route_id")).first()[0]
    if hit is not None:
        raise ValueError(f"route {hit}: {what}")


def vertices(lines: DataFrame) -> DataFrame:
    """(route_id, k, lat, lon, along_m, next_*): each line's vertices and the segment that follows."""
    points = lines.select("route_id", F.posexplode("points").alias("k", "p")).select("route_id", "k", "p.lat", "p.lon")
    stepped = geo.with_cumulative_m(points, ["route_id"], ["k"])
    order = Window.partitionBy("route_id").orderBy("k")
    return stepped.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("lat", "lon", "along_m")})


def stops_along(points: DataFrame, spacing: float) -> DataFrame:
    """(route_id, n, lat, lon, along_m): stops at even distances, ends included."""
    if not 0 < spacing < float("inf"):
        raise ValueError("stop_spacing must be positive and finite")
    total = points.groupBy("route_id").agg(F.max("along_m").alias("total"))
    require(total, F.col("total") <= 0, "the line has no length")
    count = total.withColumn("count", F.greatest(F.lit(2), F.bround(F.col("total") / spacing, 0).cast("int") + 1))
    require(count, F.col("count") > MOST, f"a stop every {spacing} m makes more than {MOST} stops")
    wanted = count.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).withColumn("at", F.col("total") * F.col("n") / (F.col("count") - 1))
    # The segment of a target is the first whose end reaches it (the last one takes rounding).
    ends = points.where("next_along_m is not null").select("route_id", "k", "lat", "lon", "along_m", "next_lat", "next_lon", "next_along_m")
    final = Window.partitionBy("route_id").orderBy(F.desc("k"))
    ends = ends.withColumn("is_last", F.row_number().over(final) == 1).withColumn("is_first", F.col("k") == 0)
    inside = ((F.col("at") <= F.col("next_along_m")) | F.col("is_last")) & ((F.col("at") > F.col("along_m")) | F.col("is_first"))
    hit = wanted.join(ends, "route_id").where(inside).groupBy("route_id", "n").agg(F.min_by(F.struct("at", "lat", "lon", "along_m", "next_lat", "next_lon", "next_along_m"), "k").alias("s")).select("route_id", "n", "s.*")
    part = F.when(F.col("next_along_m") == F.col("along_m"), F.lit(0.0)).otherwise((F.col("at") - F.col("along_m")) / F.nullif(F.col("next_along_m") - F.col("along_m"), F.lit(0.0)))
    return hit.select("route_id", "n", (F.col("lat") + part * (F.col("next_lat") - F.col("lat"))).alias("lat"), (F.col("lon") + part * (F.col("next_lon") - F.col("lon"))).alias("lon"), F.col("at").alias("along_m"))


def stops_near(points: DataFrame, stops: DataFrame, reach_m: float) -> DataFrame:
    """(route_id, stop_id, along_m) of stops(stop_id, stop_lat, stop_lon) within reach of a line.

    Segments and stops meet in the same or a neighbouring cell of a grid no
    finer than the reach, so it is an equi-join.  Distances are taken on the
    plane that touches the Earth at the line's first vertex.
    """
    first = points.where("k = 0").select("route_id", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    seg = points.where("next_lat is not null").join(first, "route_id")
    step = max(reach_m, 100.0) / geo.RADIUS_M * 57.29577951308232
    wide = step / F.greatest(F.cos(F.radians(F.greatest(F.abs("lat"), F.abs("next_lat")))), F.lit(0.01))

    def cells(a: str, b: str, margin: Column, size: float) -> Column:
        return F.sequence(F.floor((F.least(a, b) - margin) / size), F.floor((F.greatest(a, b) + margin) / size))

    seg = seg.withColumn("cell_y", F.explode(cells("lat", "next_lat", F.lit(step), step))).withColumn("cell_x", F.explode(cells("lon", "next_lon", wide, step)))
    placed = stops.withColumns({"cell_y": F.floor(F.col("stop_lat") / step), "cell_x": F.floor(F.col("stop_lon") / step)})
    met = seg.join(placed, ["cell_y", "cell_x"])
    px, py = geo.planar_m(F.col("stop_lat"), F.col("stop_lon"), F.col("lat0"), F.col("lon0"))
    ax, ay = geo.planar_m(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    bx, by = geo.planar_m(F.col("next_lat"), F.col("next_lon"), F.col("lat0"), F.col("lon0"))
    distance, part = geo.segment_distance(px, py, ax, ay, bx, by)
    met = met.withColumns({"distance": distance, "along": F.col("along_m") + part * (F.col("next_along_m") - F.col("along_m"))}).where(F.col("distance") <= reach_m)
    return met.groupBy("route_id", "stop_id").agg(F.min_by("along", F.struct("distance", "along")).alias("along_m"))


def windows(lines: DataFrame, periods: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """(route_id, period, start, end, headway): one row for each headway attribute."""
    found = []
    for name, (start, end) in (periods or {}).items():
        headway = attribute(lines, f"headway_{name}").try_cast("double") * 60
        found.append(F.when(headway.isNotNull(), F.struct(F.lit(name).alias("period"), F.lit(edit.seconds(start)).cast("bigint").alias("start"), F.lit(edit.seconds(end)).cast("bigint").alias("end"), headway.alias("headway"))))
    every = attribute(lines, "headway_min").try_cast("double") * 60
    day = F.struct(F.lit("day").alias("period"), times.as_seconds_lenient(attribute(lines, "first_departure", FIRST_DEPARTURE)).alias("start"), times.as_seconds_lenient(attribute(lines, "last_departure", LAST_DEPARTURE)).alias("end"), every.alias("headway"))
    some = F.filter(F.array(*found), lambda w: w.isNotNull()) if found else F.array().cast("array<struct<period:string,start:bigint,end:bigint,headway:double>>")
    require(lines, (F.size(some) > 0) & every.isNotNull(), "give either headway_min or headways of periods, not both")
    all_ = F.concat(some, F.when(every.isNotNull(), F.array(day)).otherwise(F.array().cast("array<struct<period:string,start:bigint,end:bigint,headway:double>>")))
    require(lines, F.size(all_) == 0, "no headway attribute")
    out = lines.select("route_id", F.inline(all_)).withColumn("headway", F.bround("headway", 0).cast("bigint"))
    require(out, F.col("end") <= F.col("start"), "a window must end after it starts")
    require(out, F.col("headway") <= 0, "a headway must be positive")
    return out


def departures(spans: DataFrame) -> DataFrame:
    """``spans(start, end, headway, ...)`` with a row for each departure: run (from 1) and departure."""
    require(spans, F.ceil((F.col("end") - F.col("start")) / F.col("headway")) > MOST, f"a window makes more than {MOST} trips")
    return spans.select("*", F.posexplode(F.sequence(F.col("start"), F.col("end") - 1, F.col("headway"))).alias("run", "departure")).withColumn("run", F.col("run") + 1)


def service_days(lines: DataFrame) -> Column:
    """Weekdays of a route as an array: a list, a name of a set, or flag columns."""
    flags = [F.when(F.lower(attribute(lines, d, "")).isin("1", "true", "yes"), F.lit(d)) for d in WEEKDAYS if d in lines.columns]
    flagged = F.filter(F.array(*flags), lambda d: d.isNotNull()) if flags else F.array().cast("array<string>")
    given = F.lower(attribute(lines, "days"))
    named = F.lit(None).cast("array<string>")
    for name, days in edit.DAYS.items():
        named = F.when(given == name, F.array(*map(F.lit, days))).otherwise(named)
    listed = F.when(F.instr(given, ",") > 0, F.transform(F.split(given, ","), lambda d: F.trim(d)))
    fallback = F.when(F.size(flagged) > 0, flagged).otherwise(F.array(*map(F.lit, edit.DAYS[DEFAULT_DAYS])))
    if flags:
        require(lines, given.isNull() & (F.size(flagged) == 0), "weekday columns present but no day is set")
    require(lines, given.isNotNull() & listed.isNull() & named.isNull(), "unknown days")
    return F.when(given.isNull(), fallback).otherwise(F.coalesce(listed, named))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with csv_row, in the order given.  Ranges are sorted apart; only their sizes are added up."""
    cells = [c for c in rows.columns if c not in order or not c.startswith("_")]
    first = F.col(order[0])
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy(first).orderBy(*order)))
    sizes = rows.groupBy(first.alias("_group")).agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before)
    out = ranked.join(sizes, first == F.col("_group"))
    return out.select((F.col("_before") + F.col("_in") + 1).alias(ROW), *[F.col(c).cast("string").alias(c) for c in cells])


def build(
    lines: DataFrame, *, timezone: str, agency_name: str = "Agency", agency_url: str = "https://example.com", stops: DataFrame | None = None, periods: Mapping[str, tuple[str, str]] | None = None, stop_spacing: float = 400.0,
    stop_snap_distance: float = 100.0, service_start: str = "20260101", service_end: str = "20261231", exact_times: bool = False,
) -> Feed:
    """A whole feed from route lines, and optionally a layer of stops(stop_id, stop_name, stop_lat, stop_lon)."""
    spark = lines.sparkSession
    require(lines, F.coalesce(F.size("points"), F.lit(0)) < 2, "needs a line of at least two points")
    mode = F.lower(attribute(lines, "mode"))
    kinds = F.create_map(*[F.lit(x) for k, v in MODE_TYPES.items() for x in (k, v)])
    require(lines, mode.isNotNull() & ~mode.isin(*MODE_TYPES), "unknown mode")
    raw_type = attribute(lines, "route_type", "3").try_cast("double")
    require(lines, mode.isNull() & (raw_type.isNull() | (raw_type != F.floor(raw_type))), "route_type must be a whole number")
    route_type = F.coalesce(kinds[mode], raw_type.cast("int"))
    points = vertices(lines).persist()
    total = points.groupBy("route_id").agg(F.max("along_m").alias("total"))
    duration, speed = attribute(lines, "duration_min").try_cast("double"), attribute(lines, "speed_kmh", SPEED_KMH).try_cast("double")
    runs = lines.select("route_id", duration.alias("duration"), speed.alias("speed")).join(total, "route_id").withColumn("run_s", F.coalesce(F.col("duration") * 60, F.col("total") / (F.col("speed") / 3.6)))
    require(runs, ~((F.col("run_s") > 0) & (F.col("run_s") < float("inf"))), "the run time must be positive and finite")
    if stops is None:
        served = stops_along(points, stop_spacing).join(runs, "route_id")
        served = served.select("route_id", F.concat("route_id", F.lit("-stop-"), (F.col("n") + 1).cast("string")).alias("stop_id"), "lat", "lon", "along_m", (F.col("run_s") * F.col("along_m") / F.col("total")).alias("offset"))
        stop_rows = served.select(F.col("route_id").alias("_route"), F.col("along_m").alias("_at"), "stop_id", F.col("stop_id").alias("stop_name"), F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"))
        stop_table = _numbered(stop_rows, "_route", "_at")
    else:
        near = stops_near(points, stops, stop_snap_distance)
        span = near.groupBy("route_id").agg(F.min("along_m").alias("first_m"), F.max("along_m").alias("last_m"), F.count(F.lit(1)).alias("n"))
        lacking = lines.select("route_id").join(span, "route_id", "left")
        require(lacking, F.coalesce("n", F.lit(0)) < 2, f"fewer than two stops within {stop_snap_distance} m of the line")
        require(span, F.col("last_m") <= F.col("first_m"), "its stops span no distance")
        served = near.join(span, "route_id").join(runs, "route_id").withColumn("offset", F.col("run_s") * (F.col("along_m") - F.col("first_m")) / (F.col("last_m") - F.col("first_m"))).select("route_id", "stop_id", "along_m", "offset")
        stop_table = _numbered(stops.select(F.col("stop_id").alias("_id"), "stop_id", "stop_name", "stop_lat", "stop_lon"), "_id")
    both_ways = ~F.lower(attribute(lines, "bidirectional", "true")).isin("false", "0", "no")
    ways = lines.select("route_id", F.explode(F.when(both_ways, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("direction"))
    end = served.groupBy("route_id").agg(F.max("offset").alias("run_end"))
    run_stops = served.join(end, "route_id").join(ways, "route_id").withColumn("offset", F.when(F.col("direction") == 1, F.col("run_end") - F.col("offset")).otherwise(F.col("offset")))
    order = Window.partitionBy("route_id", "direction").orderBy("offset", "stop_id")
    run_stops = run_stops.select("route_id", "direction", "stop_id", F.bround("offset", 0).cast("bigint").alias("offset"), F.row_number().over(order).alias("stop_sequence"))
    shape = F.concat("route_id", F.lit("-shape"), F.when(F.col("direction") == 1, "-r").otherwise(""))
    spans = windows(lines, periods).join(ways, "route_id").withColumn("trip_id", F.concat_ws("-", "route_id", "period", F.col("direction").cast("string")))
    trips = departures(spans).withColumn("trip_id", F.concat_ws("-", "trip_id", F.col("run").cast("string"))) if exact_times else spans.withColumns({"run": F.lit(1), "departure": F.col("start")})
    trip_rows = trips.select(F.col("route_id").alias("_route"), F.col("direction").alias("_way"), F.col("start").alias("_start"), F.col("run").alias("_run"), "route_id", F.concat("route_id", F.lit("-service")).alias("service_id"), "trip_id", shape.alias("shape_id"), F.col("direction").alias("direction_id"))
    when = times.clock(F.col("departure") + F.col("offset"))
    time_rows = trips.join(run_stops, ["route_id", "direction"]).select(F.col("trip_id").alias("_trip"), F.col("stop_sequence").alias("_seq"), "trip_id", when.alias("arrival_time"), when.alias("departure_time"), "stop_id", "stop_sequence")
    back = points.join(ways, "route_id").withColumn("k", F.when(F.col("direction") == 1, -F.col("k")).otherwise(F.col("k"))).withColumn("shape_id", shape)
    drawn = geo.with_cumulative_m(back.select("shape_id", "k", "lat", "lon"), ["shape_id"], ["k"])
    drawn = drawn.withColumn("shape_pt_sequence", F.row_number().over(Window.partitionBy("shape_id").orderBy("k")))
    shape_rows = drawn.select(F.col("shape_id").alias("_shape"), F.col("shape_pt_sequence").alias("_seq"), "shape_id", F.col("lat").alias("shape_pt_lat"), F.col("lon").alias("shape_pt_lon"), "shape_pt_sequence", edit.one_decimal(F.col("along_m")).alias("shape_dist_traveled"))
    days = service_days(lines)
    calendar = lines.select(F.col("route_id").alias("_route"), F.concat("route_id", F.lit("-service")).alias("service_id"), *[F.array_contains(days, d).cast("int").alias(d) for d in WEEKDAYS], F.lit(service_start).alias("start_date"), F.lit(service_end).alias("end_date"))
    routes = lines.select(F.col("route_id").alias("_route"), "route_id", F.lit("agency").alias("agency_id"), attribute(lines, "route_short_name", F.col("route_id")).alias("route_short_name"), route_type.alias("route_type"))
    agency = spark.createDataFrame([(2, "agency", agency_name, agency_url, timezone)], f"{ROW} bigint, agency_id string, agency_name string, agency_url string, agency_timezone string")
    tables = {
        "agency.txt": agency, "stops.txt": stop_table, "routes.txt": _numbered(routes, "_route"), "calendar.txt": _numbered(calendar, "_route"), "shapes.txt": _numbered(shape_rows, "_shape", "_seq"),
        "trips.txt": _numbered(trip_rows, "_route", "_way", "_start", "_run"), "stop_times.txt": _numbered(time_rows, "_trip", "_seq"),
    }
    if not exact_times:
        f = spans.select(F.col("trip_id").alias("_trip"), F.col("start").alias("_start"), "trip_id", times.clock(F.col("start")).alias("start_time"), times.clock(F.col("end")).alias("end_time"), F.col("headway").alias("headway_secs"))
        tables["frequencies.txt"] = _numbered(f, "_trip", "_start")
    return Feed(tables)


def line_of(points: Sequence[tuple[float, float]]) -> Column:
    """(lat, lon) pairs as the points of a line."""
    return F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in points])
