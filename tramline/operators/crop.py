"""Crop: the trips that serve an area and a window of dates, and all that they need.

Selection and cascade are semi-joins; ids never reach the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..feed import Feed
from ..functions import geo, text
from . import calendars

Box = tuple[float, float, float, float]
# The open ends of a one-sided window.
FIRST_DAY, LAST_DAY = "00010101", "99991231"


def inside_stops(feed: Feed, box: Box) -> DataFrame:
    """Ids of stops in the closed box (west, south, east, north)."""
    rows = feed.select("stops.txt", "stop_id", "stop_lat", "stop_lon")
    lat, lon = (text.as_float(text.utrim(F.col(c))) for c in ("stop_lat", "stop_lon"))
    return rows.where(~F.isnan(lat) & ~F.isnan(lon) & geo.in_box(lat, lon, box)).select("stop_id").distinct()


def serving(stop_times: DataFrame, stops: DataFrame, full: bool) -> DataFrame:
    """Ids of trips any of whose stop times (``full``: all) are at one of the stops."""
    inside = stops.select("stop_id", F.lit(True).alias("inside"))
    flagged = stop_times.select("trip_id", "stop_id").join(inside, "stop_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    if not full:
        return flagged.where("inside").select("trip_id").distinct()
    return flagged.groupBy("trip_id").agg(F.bool_and("inside").alias("every")).where("every").select("trip_id")


def day(value: str | None, otherwise: str) -> dt.date:
    try:
        return dt.datetime.strptime(value or otherwise, "%Y%m%d").date()
    except ValueError as e:
        raise ValueError("invalid crop date; expected YYYYMMDD") from e


def select_trips(feed: Feed, *, box: Box | None, start: str | None, end: str | None, full: bool) -> DataFrame:
    """Ids of the trips to keep."""
    if not feed.has("trips.txt", "trip_id"):
        raise OSError("the feed has no usable trips.txt with a trip_id column")
    trips = feed.select("trips.txt", "trip_id", "service_id")
    if start or end:
        first, last = day(start, FIRST_DAY), day(end, LAST_DAY)
        dates = calendars.service_calendars(feed).dates
        active = dates.where(F.col("service_date").between(F.lit(first), F.lit(last))).select("service_id").distinct()
        trips = trips.join(active, "service_id", "left_semi")
    if box is not None:
        inside = inside_stops(feed, box) if feed.has("stops.txt") else feed.tables["trips.txt"].select(F.lit("").alias("stop_id")).where("false")
        stop_times = feed.select("stop_times.txt", "trip_id", "stop_id") if feed.has("stop_times.txt") else trips.select("trip_id", F.lit("").alias("stop_id")).where("false")
        trips = trips.join(serving(stop_times, inside, full), "trip_id", "left_semi")
    return trips.select("trip_id").distinct()


def within(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is among ``ids`` (one column)."""
    return rows.join(ids.toDF("kept_id"), F.col(column) == F.col("kept_id"), "left_semi")


def blank_or_within(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is blank or among ``ids``; one outer join with the distinct ids."""
    known = ids.toDF("kept_id").distinct().withColumn("known", F.lit(True))
    return rows.join(known, F.col(column) == F.col("kept_id"), "left").where((F.col(column) == "") | F.col("known")).select(*rows.columns)


def clamped(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Calendar rows cut to the window, as text; those that end before they begin go."""
    out = rows
    if "start_date" in rows.columns:
        out = out.withColumn("start_date", F.greatest(F.col("start_date"), F.lit(start)))
    if "end_date" in rows.columns:
        out = out.withColumn("end_date", F.least(F.col("end_date"), F.lit(end)))
    return out.where("start_date <= end_date") if {"start_date", "end_date"} <= set(rows.columns) else out


def retain(feed: Feed, kept: DataFrame, start: str | None = None, end: str | None = None) -> Feed:
    """The feed with the kept trips and what refers to them or is referred to."""
    t = dict(feed.tables)

    def has(name: str, column: str) -> bool:
        return name in t and column in t[name].columns

    def referenced(name: str, column: str) -> DataFrame | None:
        return t[name].where(F.col(column) != "").select(column).distinct() if has(name, column) else None

    def keep(name: str, column: str, ids: DataFrame | None) -> None:
        if has(name, column):
            t[name] = within(t[name], column, ids) if ids is not None else t[name].where("false")

    def keep_blank(name: str, column: str, ids: DataFrame | None) -> None:
        if has(name, column):
            t[name] = blank_or_within(t[name], column, ids) if ids is not None else t[name].where(F.col(column) == "")

    for name in ("trips.txt", "stop_times.txt", "frequencies.txt"):
        keep(name, "trip_id", kept)
    stops = referenced("stop_times.txt", "stop_id")
    if stops is not None and has("stops.txt", "parent_station"):  # one hop up
        parents = within(t["stops.txt"], "stop_id", stops).where("parent_station <> ''").select("parent_station")
        stops = stops.unionAll(parents).distinct()
    keep("stops.txt", "stop_id", stops)
    routes = referenced("trips.txt", "route_id")
    keep("routes.txt", "route_id", routes)
    keep("shapes.txt", "shape_id", referenced("trips.txt", "shape_id"))
    for name in ("calendar.txt", "calendar_dates.txt"):
        keep(name, "service_id", referenced("trips.txt", "service_id"))
    if start or end:
        first, last = start or FIRST_DAY, end or LAST_DAY
        if "calendar.txt" in t:
            t["calendar.txt"] = clamped(t["calendar.txt"], first, last)
        if has("calendar_dates.txt", "date"):
            t["calendar_dates.txt"] = t["calendar_dates.txt"].where(text.utrim(F.col("date")).between(first, last))
    for name in ("transfers.txt", "pathways.txt"):
        for column in ("from_stop_id", "to_stop_id"):
            keep_blank(name, column, stops)
    for side in ("from", "to"):
        keep_blank("transfers.txt", f"{side}_route_id", routes)
        keep_blank("transfers.txt", f"{side}_trip_id", kept)
    keep_blank("attributions.txt", "route_id", routes)
    keep_blank("attributions.txt", "trip_id", kept)
    keep("route_networks.txt", "route_id", routes)
    agencies = referenced("routes.txt", "agency_id")
    if agencies is not None and agencies.limit(1).count():  # only where some kept route names one
        keep("agency.txt", "agency_id", agencies)
        keep_blank("attributions.txt", "agency_id", agencies)
    if "fare_rules.txt" in t:
        keep_blank("fare_rules.txt", "route_id", routes)
        keep("fare_attributes.txt", "fare_id", referenced("fare_rules.txt", "fare_id"))
    return Feed(t, feed.headers, feed.incomplete, feed.present, feed.notices, feed.extras)


def crop(feed: Feed, *, box: Box | None = None, start: str | None = None, end: str | None = None, full: bool = False) -> Feed:
    """Crop to a box, a window of dates, or both."""
    if box is None and not start and not end:
        raise ValueError("nothing to crop: give an area or a window of dates")
    return retain(feed, select_trips(feed, box=box, start=start, end=end, full=full), start, end)

