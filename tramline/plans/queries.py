"""Registered queries: the operators over the star-schema feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import notices as N
from .. import spec
from ..feed import Feed
from ..functions import geo, modes, text, times
from ..operators import blocks, build, calendars, conditional, crop, edit, fields, frequencies, network, references, repair, shapes, trips
from ..sources import catalog
from . import report, validate
from .star import source, star_feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Explicit days, so that no result depends on the clock.
REFERENCE_DAY = "2001-07-30"
BOX = (20.0, 15.0, 150.0, 60.0)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _context(rows: DataFrame, *keys: str, **names: str) -> DataFrame:
    """code, severity, csv_row and the named context values."""
    return rows.select("code", "severity", "csv_row", *[F.element_at("context", k).alias(n) for n, k in {**{k.lower(): k for k in keys}, **names}.items()])


def _union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    return N.union(parts, spark)


# Joins ----------------------------------------------------------------------


def _dangling(spark: SparkSession, sf_dir: str, child: str, column: str, parent: str, parent_column: str) -> DataFrame:
    f = star_feed(spark, sf_dir, child, parent)
    return references.dangling(f.select(child, column), column, f.tables[parent], parent_column).select("csv_row", F.col(column).alias("value"))


@query
def j1_dangling_stop_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dangling(spark, sf_dir, "stop_times.txt", "stop_id", "stops.txt", "stop_id")


@query
def j1_dangling_route_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dangling(spark, sf_dir, "trips.txt", "route_id", "routes.txt", "route_id")


@query
def j1_dangling_shape_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dangling(spark, sf_dir, "trips.txt", "shape_id", "shapes.txt", "shape_id")


@query
def j1_dangling_parent_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dangling(spark, sf_dir, "stops.txt", "parent_station", "stops.txt", "stop_id")


@query
def j1_foreign_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks at once, as notices."""
    found = _union(references.reference_notices(star_feed(spark, sf_dir)), spark)
    return _context(found, child="childFilename", field="childFieldName", parent="parentFilename", value="fieldValue")


@query
def j2_dangling_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star_feed(spark, sf_dir, "trips.txt", "calendar.txt", "calendar_dates.txt")
    ref = next(r for r in spec.REFERENCES if r.column == "service_id")
    return references.dangling(f.select("trips.txt", "service_id"), "service_id", references.parent_ids(f, ref), "service_id").select("csv_row", "service_id")


@query
def j3_wrong_parent_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _union(conditional.parent_stations(star_feed(spark, sf_dir, "stops.txt")), spark)
    return _context(found.where("code <> 'missing_required_field'"), parent="parentStation", kind="locationType", parent_kind="parentLocationType")


@query
def j4_unusable_trips_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star_feed(spark, sf_dir, "trips.txt", "stop_times.txt")
    return trips.without_stop_times(f.select("trips.txt", "trip_id"), f.tables["stop_times.txt"]).select("trip_id", "csv_row")


@query
def j5_single_or_unused_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of few points, many of which no trip names."""
    points = source(spark, sf_dir, "events").selectExpr("cast(event_id + 2 as bigint) as csv_row", "cast(event_id * 7919 % 9001 as string) as shape_id", "'1' as shape_pt_lat", "'2' as shape_pt_lon", "cast(event_id as string) as shape_pt_sequence")
    trips_ = source(spark, sf_dir, "orders").selectExpr("cast(o_orderkey + 2 as bigint) as csv_row", "cast(o_orderkey as string) as trip_id", "cast(o_custkey as string) as shape_id")
    found = _union(shapes.shape_notices(Feed({"shapes.txt": points, "trips.txt": trips_})), spark)
    return _context(found.where(F.col("code").isin("unused_shape", "single_shape_point")), shape="shapeId")


@query
def j5_unused_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _union(shapes.shape_notices(star_feed(spark, sf_dir, "shapes.txt", "trips.txt")), spark)
    return _context(found.where(F.col("code").isin("unused_shape", "single_shape_point")), shape="shapeId")


@query
def j7_block_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star_feed(spark, sf_dir, "trips.txt", "stop_times.txt", "calendar.txt", "calendar_dates.txt")
    pairs = blocks.overlapping(validate.block_members(f), calendars.service_calendars(f).dates)
    return pairs.select("block_id", "trip_a", "trip_b", "row_b")


@query
def j8_shared_service_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of services and day shifts with a date in common."""
    f = star_feed(spark, sf_dir, "calendar.txt", "calendar_dates.txt")
    dates = calendars.service_calendars(f).dates
    names = dates.select("service_id").distinct()
    wanted = names.toDF("service_a").join(names.toDF("service_b"), F.col("service_a") < F.col("service_b")).withColumn("shift", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    return blocks.shared_days(dates, wanted)


@query
def j16_nearest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = source(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "cast(s_suppkey * 37 % 9000 as double) / 1000 as lat", "cast(s_suppkey * 91 % 9000 as double) / 1000 as lon")
    points = source(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as point_id", "cast(n_nationkey * 531 % 9000 as double) / 1000 as lat", "cast(n_nationkey * 777 % 9000 as double) / 1000 as lon")
    return network.nearest(points, "point_id", nodes).select("point_id", "id", F.round("distance_m", 3).alias("distance_m"))


# Keys, groups and windows -----------------------------------------------------


@query
def s_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star_feed(spark, sf_dir, "stop_times.txt")
    key = ["trip_id", "stop_sequence"]
    return references.repeated_keys(f.select("stop_times.txt", *key), key, key).select("csv_row", "first_row", *key)


def _stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.parsed(star_feed(spark, sf_dir, "stop_times.txt"))


@query
def a3_unusable_trips_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stop_times(spark, sf_dir)
    each = rows.groupBy("trip_id").agg(F.count(F.lit(1)).alias("stops"), F.min_by("csv_row", F.struct("seq", "csv_row")).alias("csv_row"))
    return each.where("stops < 2").select("trip_id", "csv_row")


@query
def a4_trip_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = trips.spans(_stop_times(spark, sf_dir))
    return s.select("trip_id", F.col("start").alias("first_s"), F.col("end").alias("last_s"), "first_row")


@query
def a5_service_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.window(calendars.service_calendars(star_feed(spark, sf_dir, "calendar.txt", "calendar_dates.txt")).dates).select(F.col("first").alias("first_day"), F.col("last").alias("last_day"))


@query
def a6_expired_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services (one a customer) whose last day lies before the reference day."""
    dates = source(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("service_id"), F.col("o_orderdate").cast("date").alias("service_date")).distinct()
    late = calendars.expired(dates, "2001-03-01")
    return late.select("service_id", F.date_format("last_date", "yyyyMMdd").alias("last_day"))


@query
def a6_expired_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star_feed(spark, sf_dir, "calendar.txt", "calendar_dates.txt")
    late = calendars.expired(calendars.service_calendars(f).dates, REFERENCE_DAY)
    return late.select("service_id", F.date_format("last_date", "yyyyMMdd").alias("last_day"))


@query
def a9_notices_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _all_notices(spark, sf_dir)
    return N.by_code(found).select("code", "severity", "total", F.size("samples").cast("bigint").alias("samples"))


@query
def a10_severity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = report.merged(N.by_code(_all_notices(spark, sf_dir)), _hosted(spark, sf_dir))
    return report.severity_totals(groups)


@query
def a13_modes_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, "part").selectExpr("cast(p_size * 27 as string) as route_type")
    return modes.served(rows)


@query
def a16_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = shapes.polylines(shapes.parsed(star_feed(spark, sf_dir, "shapes.txt")))
    at = lines["line"]
    return lines.select("shape_id", F.size("line").cast("bigint").alias("points"), F.element_at(at, 1)["lat"].alias("first_lat"), F.element_at(at, -1)["lon"].alias("last_lon"))


@query
def w1_stop_time_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered checks of the stop times, as notices."""
    found = _union(trips.trip_notices(star_feed(spark, sf_dir, "stop_times.txt")), spark)
    return _context(found, trip="tripId", field="specifiedField", prev="prevCsvRowNumber")


@query
def w5_arrival_before_previous_departure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = trips.progressed(_stop_times(spark, sf_dir))
    return p.where("stops >= 2 and arrival < prev.departure").select("trip_id", "csv_row", F.col("prev.csv_row").alias("prev_row"))


@query
def w6_distance_not_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = trips.progressed(_stop_times(spark, sf_dir))
    return p.where("stops >= 2 and distance <= prev_distance").select("trip_id", "csv_row")


@query
def w8_overlapping_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _union(frequencies.frequency_notices(star_feed(spark, sf_dir, "frequencies.txt")), spark)
    return _context(found, trip="tripId", prev="prevCsvRowNumber")


@query
def w9_shape_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.compared(shapes.parsed(star_feed(spark, sf_dir, "shapes.txt")))


@query
def w14_block_pair_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that pairs of a block's trips are looked at under."""
    f = star_feed(spark, sf_dir, "trips.txt", "stop_times.txt")
    m = blocks.ranked(validate.block_members(f))
    a, b = m.select("block_id", F.col("i").alias("i_a"), "n"), m.select("block_id", F.col("i").alias("i_b"))
    pairs = a.join(b, "block_id").where("i_a < i_b")
    return pairs.select("block_id", F.col("i_a").cast("bigint").alias("i_a"), F.col("i_b").cast("bigint").alias("i_b"), blocks.pair_number(F.col("i_a"), F.col("i_b"), F.col("n")).alias("number"))


@query
def w15_idle_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[F.max(((F.weekday("o_orderdate") == k) & (F.col("o_orderstatus") == "F")).cast("int")).cast("string").alias(d) for k, d in enumerate(spec.WEEKDAYS)], F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    feed = Feed({"calendar.txt": rows.select((F.col("o_custkey") + 2).alias("csv_row"), F.col("o_custkey").cast("string").alias("service_id"), *spec.WEEKDAYS, F.date_format("a", "yyyyMMdd").alias("start_date"), F.date_format("b", "yyyyMMdd").alias("end_date"))})
    return _context(_union(calendars.service_calendars(feed).notices, spark), service="serviceId")


@query
def w19_cumulative_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = source(spark, sf_dir, "events").selectExpr("user_id", "event_id", "cast(event_id * 13 % 9500 as double) / 100 as lat", "cast(event_id * 29 % 18500 as double) / 100 as lon")
    return geo.with_cumulative_m(points, ["user_id"], ["event_id"]).select("user_id", "event_id", F.round("along_m", 2).alias("along_m"))


@query
def w20_sampled_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(N.sampled(_all_notices(spark, sf_dir), 25), suppressed="suppressedCount").select("code", "severity", "csv_row", "suppressed")


@query
def u2_service_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star_feed(spark, sf_dir, "calendar.txt", "calendar_dates.txt")
    return calendars.service_calendars(f).dates.select("service_id", F.date_format("service_date", "yyyyMMdd").alias("day"))


# Field and conditional rules ----------------------------------------------------


def _all_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rules' notices together: the input of quotas and reports."""
    f = star_feed(spark, sf_dir, "stops.txt", "trips.txt", "routes.txt", "transfers.txt", "agency.txt")
    parts = [p for n in sorted(f.tables) for p in fields.field_notices(f, n)]
    return _union([*parts, *conditional.stop_places(f), *conditional.transfer_times(f)], spark)


def _cells(spark: SparkSession, sf_dir: str, table: str, row: str, value: str, column: spec.ColumnSpec) -> DataFrame:
    rows = source(spark, sf_dir, table).selectExpr(f"cast({row} as bigint) as csv_row", f"{value} as value")
    return _context(fields.emit_cells(rows, [(0, "value", column)], "cells.txt"), value="fieldValue")


@query
def f_required_and_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = "case when p_partkey % 10 = 0 then '' when p_partkey % 10 = 1 then concat(' ', p_name) when p_partkey % 10 = 2 then concat(p_name, char(9)) when p_partkey % 10 = 3 then concat(p_name, char(10), p_type) else p_name end"
    return _cells(spark, sf_dir, "part", "p_partkey", value, spec.ColumnSpec("c", "text", True))


@query
def f_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = "case when o_orderkey % 3 = 0 then concat(substring(date_format(o_orderdate, 'yyyyMMdd'), 1, 6), cast(20 + o_orderkey % 15 as string)) when o_orderkey % 3 = 1 then date_format(o_orderdate, 'yyyy-MM-dd') else date_format(o_orderdate, 'yyyyMMdd') end"
    return _cells(spark, sf_dir, "orders", "o_orderkey", value, spec.ColumnSpec("c", "date", False))


@query
def f_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = "concat(cast(o_orderkey % 130 as string), ':', lpad(cast(o_orderkey % 70 as string), 2, '0'), ':', cast(o_orderkey % 65 as string))"
    return _cells(spark, sf_dir, "orders", "o_orderkey", value, spec.ColumnSpec("c", "time", False))


@query
def f_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = "case when c_custkey % 5 = 0 then concat('+', cast(c_custkey as string)) when c_custkey % 5 = 1 then concat('-', cast(c_custkey as string)) when c_custkey % 5 = 2 then cast(c_acctbal as string) else cast(c_custkey as string) end"
    return _cells(spark, sf_dir, "customer", "c_custkey", value, spec.ColumnSpec("c", "int", False, least=3, most=1000))


@query
def f_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = "case when c_custkey % 6 = 0 then 'NaN' when c_custkey % 6 = 1 then concat(cast(c_custkey as string), 'd') when c_custkey % 6 = 2 then concat('.', cast(c_custkey as string), 'e2') when c_custkey % 6 = 3 then '-inf' else cast(c_custkey * 10 as string) end"
    return _cells(spark, sf_dir, "customer", "c_custkey", value, spec.ColumnSpec("c", "float", False, least=0.0, most=5000.0))


@query
def f_enumerations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "part", "p_partkey", "case when p_size % 7 = 0 then p_type else cast(p_size as string) end", spec.ColumnSpec("c", "enum", False, values=(1, 2, 3, 5, 8, 13, 21, 34)))


@query
def f_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _union(fields.field_notices(star_feed(spark, sf_dir, "stops.txt"), "stops.txt"), spark)
    return _context(found, field="fieldName", value="fieldValue")


@query
def f_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _union(fields.field_notices(star_feed(spark, sf_dir, "agency.txt"), "agency.txt"), spark)
    return _context(found, field="fieldName", value="fieldValue")


@query
def c_stop_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(_union(conditional.stop_places(star_feed(spark, sf_dir, "stops.txt")), spark), stop="stopId")


@query
def c_stop_time_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, "orders").selectExpr("o_orderkey as csv_row", "case when o_orderkey % 2 = 0 then 'a' else '' end as stop_id", "case when o_orderkey % 3 = 0 then 'b' else '' end as location_group_id", "'' as location_id")
    return _context(_union(conditional.stop_time_places(Feed({"stop_times.txt": rows})), spark), field="fieldName")


@query
def c_transfer_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(_union(conditional.transfer_times(star_feed(spark, sf_dir, "transfers.txt")), spark), field="fieldName")


@query
def c_route_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(_union(conditional.route_rules(star_feed(spark, sf_dir, "routes.txt"), True), spark), route="routeId")


@query
def c_agency_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(_union(conditional.agency_rules(star_feed(spark, sf_dir, "agency.txt"), True), spark), expected="expected", actual="actual")


@query
def c_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    swapped = star_feed(spark, sf_dir, "frequencies.txt").tables["frequencies.txt"]
    swapped = swapped.withColumn("end_time", F.when(F.col("csv_row") % 7 == 0, F.col("start_time")).otherwise(F.col("end_time"))).withColumns({"start_time": F.when(F.col("csv_row") % 11 == 0, F.col("end_time")).otherwise(F.col("start_time")), "end_time": F.when(F.col("csv_row") % 11 == 0, F.col("start_time")).otherwise(F.col("end_time"))})
    return _context(_union(conditional.ranges(Feed({"frequencies.txt": swapped})), spark))


# Crop, repair and edits -----------------------------------------------------------


def _cropped(spark: SparkSession, sf_dir: str) -> Feed:
    return star_feed(spark, sf_dir, "trips.txt", "stop_times.txt", "stops.txt", "routes.txt", "calendar.txt", "calendar_dates.txt", "agency.txt", "transfers.txt", "shapes.txt", "frequencies.txt")


@query
def j9_crop_trips_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop.select_trips(_cropped(spark, sf_dir), box=BOX, start=None, end=None, full=False)


@query
def a14_crop_trips_fully_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop.select_trips(_cropped(spark, sf_dir), box=BOX, start=None, end=None, full=True)


@query
def j9_crop_trips_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop.select_trips(_cropped(spark, sf_dir), box=None, start="20010730", end=None, full=False)


def _counts(feed: Feed) -> DataFrame:
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n.removesuffix(".txt")).alias("file"), "n") for n, t in sorted(feed.tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query
def j10_crop_cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(crop.crop(_cropped(spark, sf_dir), box=BOX, start="19960101", end="19980101"))


@query
def t7_clamped_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_feed(spark, sf_dir, "calendar.txt").tables["calendar.txt"]
    return crop.clamped(rows, "19960101", "19980101").select("service_id", "start_date", "end_date")


@query
def t3_repair_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star_feed(spark, sf_dir, "trips.txt")
    plan = repair.defaults_plan(_union(fields.field_notices(f, "trips.txt"), spark)).where("field = 'wheelchair_accessible'")
    return repair.changed_cells(f.tables["trips.txt"], plan, "trips.txt", "wheelchair_accessible", "0", "default_value")


@query
def t4_repair_cleared_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star_feed(spark, sf_dir, "trips.txt", "shapes.txt", "routes.txt", "calendar.txt", "calendar_dates.txt")
    plan = repair.dangling_plan(_union(references.reference_notices(f), spark)).where("file = 'trips.txt' and field = 'shape_id'")
    return repair.set_cells(f.tables["trips.txt"], plan, "shape_id", "").select("trip_id", "shape_id")


@query
def t6_repair_dropped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star_feed(spark, sf_dir, "stops.txt")
    plan = repair.doomed_plan(_union(conditional.stop_places(f), spark))
    return repair.drop_rows(f.tables["stops.txt"], plan).select("stop_id", "csv_row")


@query
def j11_repair_cascade_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one round of the cascade leaves, by table."""
    f = star_feed(spark, sf_dir, "stops.txt", "trips.txt", "routes.txt", "stop_times.txt", "frequencies.txt", "transfers.txt")
    return _counts(repair.cascade_round(f)[0])


@query
def t11_updated_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_feed(spark, sf_dir, "stops.txt").tables["stops.txt"]
    return edit.updated(rows, F.col("stop_id") == "1", {"stop_name": "Main", "zone_id": "Z"}).select("stop_id", "stop_name", "zone_id")


@query
def t12_set_headway(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_feed(spark, sf_dir, "frequencies.txt").tables["frequencies.txt"]
    return edit.updated(rows, F.col("trip_id") == "7", {"headway_secs": 600, "end_time": "23:00:00"}).select("csv_row", "headway_secs", "end_time")


@query
def t13_shifted_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_feed(spark, sf_dir, "stop_times.txt").tables["stop_times.txt"]
    hit = F.col("trip_id").cast("bigint") % 100 == 0
    return edit.shifted(rows, hit, ["arrival_time", "departure_time"], 86_399).select("csv_row", "arrival_time", "departure_time")


@query
def t14_dropped_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star_feed(spark, sf_dir, "routes.txt", "trips.txt", "stop_times.txt")
    return _counts(edit.without_routes(f, spark.createDataFrame([("3",)], "route_id string")))


@query
def u5_appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_feed(spark, sf_dir, "routes.txt").tables["routes.txt"]
    return edit.appended(rows, edit.rows_of(spark, [{"route_id": "new", "route_type": 3, "route_color": "FFFFFF"}]))


@query
def t15_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact departures of headway windows."""
    spans = source(spark, sf_dir, "nation").selectExpr("n_nationkey as route_id", "cast(21600 + n_nationkey * 60 as bigint) as start", "cast(36000 + n_regionkey * 600 as bigint) as end", "cast(600 + n_nationkey * 30 as bigint) as headway")
    return build.departures(spans).select(F.col("route_id").alias("route"), F.col("run").cast("bigint").alias("run"), "departure")


@query
def t15_stops_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops every 400 km on a straight line per nation."""
    points = source(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as string) as route_id", "array(named_struct('lat', cast(0 as double), 'lon', cast(0 as double)), named_struct('lat', cast(0 as double), 'lon', cast(n_nationkey + 1 as double))) as points")
    found = build.stops_along(build.vertices(points), 40_000.0)
    return found.select("route_id", F.col("n").cast("bigint").alias("n"), F.round("lon", 6).alias("lon"), F.round("along_m", 3).alias("along_m"))


@query
def u6_orphan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that only every hundredth order has, by way deletion."""
    line = source(spark, sf_dir, "lineitem")
    ways = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("nodes"))
    nodes = line.select(F.col("l_partkey").alias("id")).distinct()
    return network.Network(nodes, ways).orphans(F.col("id") % 100 == 0).select(F.col("id").alias("node"))


@query
def u6_nodes_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes left when the ways of every hundredth order are deleted; a node is a part in a quantity."""
    line = source(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") * 100 + F.col("l_quantity").cast("bigint")).alias("node"))
    ways = line.groupBy("id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    nodes = line.select(F.col("node").alias("id")).distinct()
    return network.Network(nodes, ways).delete_ways(F.col("id") % 100 == 0).nodes.select(F.col("id").alias("node"))


@query
def g_gaps_and_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line")).distinct()
    runs = network.runs_of(rows, "l_orderkey", "line")
    return runs.groupBy("l_orderkey", F.col("run").cast("bigint").alias("run")).agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"))


# Scalars ------------------------------------------------------------------------


@query
def x_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_feed(spark, sf_dir, "frequencies.txt").tables["frequencies.txt"]
    s = times.as_seconds(F.col("start_time"))
    return rows.select("csv_row", s.alias("seconds"), times.clock(s + 90_000).alias("later"), times.as_seconds_lenient(F.regexp_replace("start_time", ":0", ":")).alias("lenient"))


@query
def x_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, "supplier").selectExpr("s_suppkey", "cast(s_suppkey * 37 % 9000 as double) / 100 as lat", "cast(s_suppkey * 91 % 18000 as double) / 100 as lon")
    return rows.select("s_suppkey", F.round(geo.haversine_m(F.lit(60.17), F.lit(24.94), F.col("lat"), F.col("lon")), 3).alias("metres"))


@query
def x_text_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return source(spark, sf_dir, "documents").select("doc_id", text.clip(t).alias("clipped"), text.html_escape(text.clip(t)).alias("html"), text.slug(t).alias("slug"))


@query
def x_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "pages").select("page_id", text.md_escape(F.col("html")).alias("cell"))


@query
def x_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, "pages").selectExpr("page_id", "substring(url, instr(url, '://') + 3) as name")
    return rows.select("page_id", text.safe_member(F.col("name")).alias("member"), text.safe_id(F.regexp_replace("name", "/.*", "")).alias("id"))


@query
def x_route_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") * 27
    return source(spark, sf_dir, "part").select("p_partkey", kind.cast("bigint").alias("route_type"), modes.mode_of(kind).alias("mode"))


# Catalogue and reports --------------------------------------------------------------


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as catalogue entries."""
    rows = source(spark, sf_dir, "supplier")
    side = {"west": "cast(s_suppkey % 90 as double)", "south": "cast(s_suppkey % 40 as double)", "east": "cast(s_suppkey % 90 + s_nationkey as double)", "north": "cast(s_suppkey % 40 + 5 as double)"}
    place = F.array(F.struct(F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("country_code"), F.col("s_name").alias("subdivision_name"), F.lit("m").alias("municipality")))
    return rows.select(
        F.col("s_suppkey").cast("string").alias("id"), F.lit("gtfs").alias("data_type"), F.when(F.col("s_suppkey") % 3 == 0, "inactive").otherwise("active").alias("status"), (F.col("s_acctbal") > 5000).alias("official"), F.col("s_name").alias("provider"),
        place.alias("locations"), *[F.when(F.col("s_suppkey") % 13 != 0, F.expr(e)).alias(n) for n, e in side.items()],
    )


@query
def t18_catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.search(_feeds(spark, sf_dir), area=(10.0, 5.0, 60.0, 30.0), limit=None)
    return found.select("id", "official")


@query
def t18_catalog_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(_feeds(spark, sf_dir), country_code="C7", status=None, area=(0.0, 0.0, 95.0, 50.0), enclosure="completely_enclosed", limit=None).select("id", "status")


@query
def l2_ranked_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best, with their places."""
    top = catalog.ranked(_feeds(spark, sf_dir)).limit(10).withColumn("k", F.monotonically_increasing_id())
    return top.select("id", F.row_number().over(Window.orderBy("k")).cast("bigint").alias("place"))


@query
def l3_dataset_for_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("downloaded_at"), F.col("o_orderdate").cast("date").alias("first_day"), F.when(F.col("o_orderkey") % 2 == 0, F.date_add(F.col("o_orderdate").cast("date"), 60)).alias("last_day"))
    return catalog.dataset_for(rows, "1998-03-01").select("id", F.date_format("first_day", "yyyyMMdd").alias("first_day"))


def _hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another validator's groups, from the part table."""
    rows = source(spark, sf_dir, "part")
    code = F.when(F.col("p_size") % 4 == 0, "number_out_of_range").when(F.col("p_size") % 4 == 1, "point_near_origin").when(F.col("p_size") % 4 == 2, "hosted_only").otherwise("unexpected_enum_value")
    return rows.groupBy(code.alias("code")).agg(F.lit("WARNING").alias("severity"), F.count(F.lit(1)).alias("total"))


@query
def j13_merged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = report.merged(N.by_code(_all_notices(spark, sf_dir)).drop("samples"), _hosted(spark, sf_dir))
    return groups.select("code", "severity", "source", "total", "local_total", "hosted_total")


@query
def j14_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.parity(report.merged(N.by_code(_all_notices(spark, sf_dir)).drop("samples"), _hosted(spark, sf_dir)))


@query
def l5_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = report.in_order(report.merged(N.by_code(_all_notices(spark, sf_dir)).drop("samples"), _hosted(spark, sf_dir))).withColumn("k", F.monotonically_increasing_id())
    return groups.select("code", F.row_number().over(Window.orderBy("k")).cast("bigint").alias("place"))


@query
def t1_validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every rule over the whole feed, counted by code."""
    f = star_feed(spark, sf_dir)
    semantic, _ = validate.semantic_notices(f, spark, REFERENCE_DAY)
    found = N.union([N.union(references.key_notices(f), spark), validate.rule_notices(f, spark), semantic], spark)
    return found.groupBy("stage", "code", "severity").agg(F.count(F.lit(1)).alias("n"))

