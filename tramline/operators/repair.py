"""Repair: notices become a plan of fixes, which joins apply to the tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import notices as N
from ..feed import Feed
from ..functions import text
from ..tables import unused, written

# Optional fields and the default that replaces a bad value.
DEFAULTS = (
    ("stops.txt", "location_type", "0"),
    ("stops.txt", "wheelchair_boarding", "0"),
    ("routes.txt", "continuous_pickup", "1"),
    ("routes.txt", "continuous_drop_off", "1"),
    ("trips.txt", "wheelchair_accessible", "0"),
    ("trips.txt", "bikes_allowed", "0"),
    ("trips.txt", "cars_allowed", "0"),
    ("stop_times.txt", "pickup_type", "0"),
    ("stop_times.txt", "drop_off_type", "0"),
    ("stop_times.txt", "timepoint", "1"),
    ("frequencies.txt", "exact_times", "0"),
)
# References that are cleared when they dangle; all others drop their row.
CLEARABLE = (
    ("trips.txt", "shape_id"),
    ("stops.txt", "level_id"),
    ("routes.txt", "network_id"),
    ("fare_attributes.txt", "agency_id"),
    ("attributions.txt", "agency_id"),
    ("attributions.txt", "route_id"),
    ("attributions.txt", "trip_id"),
    ("stop_times.txt", "pickup_booking_rule_id"),
    ("stop_times.txt", "drop_off_booking_rule_id"),
)
BAD_VALUES = ("unexpected_enum_value", "invalid_integer", "number_out_of_range")
DOOMING = ("duplicate_key", "missing_required_field", "invalid_date", "invalid_time")
# Codes whose notices don't name the file whose row they doom.
DOOMED_IN = {"stop_without_location": "stops.txt", "departure_before_arrival": "stop_times.txt", "stop_time_with_arrival_before_previous_departure_time": "stop_times.txt"}
ROUNDS = 4

FIXES = "action string, filename string, csv_row bigint, field string, old_value string, new_value string, triggered_by string"


@dataclass(frozen=True)
class Repaired:
    feed: Feed
    fixes: DataFrame


def defaults_plan(notices: DataFrame) -> DataFrame:
    """(file, csv_row, field, code) of cells whose bad value has a default."""
    known = F.concat_ws(":", "file", "field").isin(*[f"{f}:{c}" for f, c, _ in DEFAULTS])
    rows = notices.where(F.col("code").isin(*BAD_VALUES)).select(F.element_at("context", "filename").alias("file"), "csv_row", F.element_at("context", "fieldName").alias("field"), "code")
    return rows.where(known).groupBy("file", "csv_row", "field").agg(F.max("code").alias("code"))


def set_cells(table: DataFrame, rows: DataFrame, field: str, value: str) -> DataFrame:
    """``table`` with ``field`` set in the rows(csv_row) given."""
    hit = rows.select("csv_row").distinct().withColumn("hit", F.lit(True))
    return table.join(hit, "csv_row", "left").withColumn(field, F.when(F.col("hit"), F.lit(value)).otherwise(F.col(field))).select(*table.columns)


def changed_cells(table: DataFrame, rows: DataFrame, file: str, field: str, value: str, action: str) -> DataFrame:
    """The fixes of :func:`set_cells`; ``rows(csv_row, code)``."""
    cells = table.select("csv_row", F.col(field).alias("old_value")).join(rows.select("csv_row", "code"), "csv_row")
    return cells.select(F.lit(action).alias("action"), F.lit(file).alias("filename"), "csv_row", F.lit(field).alias("field"), "old_value", F.lit(value).alias("new_value"), F.col("code").alias("triggered_by"))


def dangling_plan(notices: DataFrame) -> DataFrame:
    """(file, field, csv_row) of dangling references."""
    return notices.where(F.col("code") == "foreign_key_violation").select(F.element_at("context", "childFilename").alias("file"), F.element_at("context", "childFieldName").alias("field"), "csv_row").distinct()


def doomed_plan(notices: DataFrame) -> DataFrame:
    """(file, csv_row, code) of rows that other defects doom."""
    named = F.element_at("context", "filename")
    file = named
    for code, own in DOOMED_IN.items():
        file = F.when(F.col("code") == code, own).otherwise(file)
    rows = notices.where(F.col("code").isin(*DOOMING, *DOOMED_IN)).where("csv_row is not null").select(file.alias("file"), "csv_row", "code").where("file is not null")
    return rows.groupBy("file", "csv_row").agg(F.max("code").alias("code"))


def drop_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.join(rows.select("csv_row"), "csv_row", "left_anti")


def dropped(rows: DataFrame, file: str) -> DataFrame:
    """The fixes of dropping rows(csv_row, code)."""
    none = F.lit(None).cast("string")
    return rows.select(F.lit("drop_entity").alias("action"), F.lit(file).alias("filename"), "csv_row", none.alias("field"), none.alias("old_value"), none.alias("new_value"), F.col("code").alias("triggered_by"))


def cascade_round(feed: Feed) -> tuple[Feed, dict[str, DataFrame]]:
    """One round towards referential consistency: (feed, rows lost by file).

    Stops, trips and routes are those at the round's start, except that
    frequencies look at the trips that the round leaves.
    """
    t = dict(feed.tables)
    lost: dict[str, DataFrame] = {}

    def ids(name: str, column: str) -> DataFrame | None:
        return t[name].select(F.col(column).alias("id")).distinct().withColumn("known", F.lit(True)) if name in t and column in t[name].columns else None

    def check(rows: DataFrame, column: str, known: DataFrame | None, flag: str, blank: bool) -> DataFrame:
        if column not in rows.columns:
            return rows.withColumn(flag, F.lit(blank))
        held = F.lit(False) if known is None else F.coalesce(F.col("known"), F.lit(False))
        out = rows if known is None else rows.join(known, F.col(column) == F.col("id"), "left")
        ok = held | (F.col(column) == "") if blank else held
        return out.withColumn(flag, ok).drop("id", "known")

    def split(name: str, rows: DataFrame, ok: str) -> None:
        """Each table is judged once and written with its verdict; what follows scans that."""
        columns = t[name].columns
        stays = unused("stays", columns)
        judged = written(rows.withColumn(stays, F.expr(ok)).select(*columns, stays), "cascade")
        lost[name] = judged.where(~F.col(stays)).select("csv_row", F.lit("cascade").alias("code"))
        t[name] = judged.where(F.col(stays)).select(*columns)

    stops, trips, routes = ids("stops.txt", "stop_id"), ids("trips.txt", "trip_id"), ids("routes.txt", "route_id")
    if "stop_times.txt" in t:
        split("stop_times.txt", check(check(t["stop_times.txt"], "stop_id", stops, "stop_ok", True), "trip_id", trips, "trip_ok", False), "stop_ok and trip_ok")
    if "trips.txt" in t:
        used = t["stop_times.txt"].groupBy(F.col("trip_id").alias("used_id")).agg(F.count(F.lit(1)).alias("used")) if "stop_times.txt" in t else None
        rows = check(t["trips.txt"], "route_id", routes, "route_ok", False)
        rows = rows.join(used, F.col("trip_id") == F.col("used_id"), "left") if used is not None else rows.withColumn("used", F.lit(0))
        split("trips.txt", rows, "route_ok and coalesce(used, 0) >= 2")
    if "frequencies.txt" in t:
        split("frequencies.txt", check(t["frequencies.txt"], "trip_id", ids("trips.txt", "trip_id"), "trip_ok", False), "trip_ok")
    for name in ("transfers.txt", "pathways.txt"):
        if name in t:
            split(name, check(check(t[name], "from_stop_id", stops, "from_ok", True), "to_stop_id", stops, "to_ok", True), "from_ok and to_ok")
    return Feed(t, feed.headers, feed.incomplete, feed.present, feed.notices, feed.extras), lost


def cascade(feed: Feed, rounds: int = ROUNDS) -> Repaired:
    """Rounds until one changes nothing, at most ``rounds``."""
    spark = next(iter(feed.tables.values())).sparkSession
    fixes = spark.createDataFrame([], FIXES)
    for _ in range(rounds):
        after, lost = cascade_round(feed)
        parts = [dropped(rows, name) for name, rows in lost.items()]
        found = parts[0] if parts else fixes.limit(0)
        for p in parts[1:]:
            found = found.unionAll(p)
        found = written(found, "cascade-fixes")
        if not found.limit(1).count():
            break
        fixes = fixes.unionAll(found)
        feed = after
    return Repaired(feed, fixes)


def repair(feed: Feed, notices: DataFrame, *, strict_compat: bool = False) -> Repaired:
    """Defaults, cleared references, dropped rows, cascade, in that order.

    A dangling parent station of a stop or station, or the agency of a route
    in a feed with at most one agency, is cleared and the row kept;
    ``strict_compat`` drops that row all the same.
    """
    if notices.where(F.col("code") == N.LIMIT).limit(1).count():
        raise OSError("the notices are incomplete: raise max_notices_per_file before repairing")
    t = dict(feed.tables)
    fixes: list[DataFrame] = []

    def set_values(rows: DataFrame, file: str, field: str, value: str, action: str) -> None:
        if file in t and field in t[file].columns:
            fixes.append(changed_cells(t[file], rows, file, field, value, action))
            t[file] = set_cells(t[file], rows, field, value)

    plan = defaults_plan(notices).persist()
    wanted = {(r.file, r.field) for r in plan.select("file", "field").distinct().collect()}
    for file, field, value in DEFAULTS:
        if (file, field) in wanted:
            set_values(plan.where((F.col("file") == file) & (F.col("field") == field)), file, field, value, "default_value")
    dangling = dangling_plan(notices).withColumn("code", F.lit("foreign_key_violation")).persist()
    doomed = doomed_plan(notices)
    clear = F.concat_ws(":", "file", "field").isin(*[f"{f}:{c}" for f, c in CLEARABLE])
    at_will = (("stops.txt", "parent_station"), ("routes.txt", "agency_id"))
    spare = dangling.where("false").select("file", "csv_row")
    pairs = {(r.file, r.field) for r in dangling.select("file", "field").distinct().collect()}
    one_agency = "agency.txt" not in t or t["agency.txt"].limit(2).count() <= 1
    for file, field in sorted(pairs):
        own = dangling.where((F.col("file") == file) & (F.col("field") == field)).select("csv_row", "code")
        if (file, field) in CLEARABLE:
            set_values(own, file, field, "", "clear_reference")
        elif (file, field) in at_will and file in t:
            if field == "parent_station":
                kind = text.utrim(F.col("location_type")) if "location_type" in t[file].columns else F.lit("")
                own = own.join(t[file].where(kind.isin("", "0", "1")).select("csv_row"), "csv_row", "left_semi")
            elif not one_agency:
                continue
            set_values(own, file, field, "", "clear_reference")
            spare = spare if strict_compat else spare.unionAll(own.select(F.lit(file).alias("file"), "csv_row"))
    # A row doomed by its dangling reference alone is spared if that was cleared.
    lost = dangling.where(~clear).groupBy("file", "csv_row", "code").agg(F.count(F.lit(1)).alias("times"))
    saved = spare.groupBy("file", "csv_row").agg(F.count(F.lit(1)).alias("saved"))
    lost = lost.join(saved, ["file", "csv_row"], "left").where("times > coalesce(saved, 0)").select("file", "csv_row", "code")
    order = F.when(F.col("code") == "foreign_key_violation", 0).otherwise(1)
    lost = lost.unionAll(doomed).groupBy("file", "csv_row").agg(F.max_by("code", order).alias("code")).persist()
    for file in sorted(r.file for r in lost.select("file").distinct().collect()):
        if file in t:
            own = lost.where(F.col("file") == file)
            present = t[file].select("csv_row").join(own.select("csv_row", "code"), "csv_row")
            fixes.append(dropped(present, file))
            t[file] = drop_rows(t[file], own)
    done = cascade(Feed(t, feed.headers, feed.incomplete, feed.present, None, feed.extras))
    log = done.fixes
    for f in fixes:
        log = f.unionAll(log)
    return Repaired(done.feed, log)
