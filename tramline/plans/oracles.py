"""DuckDB SQL for each registered query, over the driver's views."""

from __future__ import annotations

from .. import spec
from ..functions import modes
from .star import prelude

ORACLES: dict[str, str] = {}

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _dangling(child: str, column: str, parent: str, parent_column: str) -> str:
    return f"{prelude(f'{child}.txt', *([f'{parent}.txt'] if parent != child else []))} SELECT c.csv_row, c.{column} AS value FROM {child} c WHERE c.{column} <> '' AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_column} = c.{column})"


ORACLES["j1_dangling_stop_ids"] = _dangling("stop_times", "stop_id", "stops", "stop_id")
ORACLES["j1_dangling_route_ids"] = _dangling("trips", "route_id", "routes", "route_id")
ORACLES["j1_dangling_shape_ids"] = _dangling("trips", "shape_id", "shapes", "shape_id")
ORACLES["j1_dangling_parent_stations"] = _dangling("stops", "parent_station", "stops", "stop_id")

_STAR = ("agency.txt", "routes.txt", "trips.txt", "stop_times.txt", "stops.txt", "calendar.txt", "calendar_dates.txt", "frequencies.txt", "shapes.txt", "transfers.txt")
_STAR_REFERENCES = (
    "trips.route_id routes.route_id", "trips.service_id calendar.service_id", "trips.shape_id shapes.shape_id", "stop_times.trip_id trips.trip_id", "stop_times.stop_id stops.stop_id", "stops.parent_station stops.stop_id",
    "routes.agency_id agency.agency_id", "frequencies.trip_id trips.trip_id", "transfers.from_stop_id stops.stop_id", "transfers.to_stop_id stops.stop_id",
)


def _foreign_keys() -> str:
    parts = []
    for line in _STAR_REFERENCES:
        (child, column), (parent, key) = (p.split(".") for p in line.split())
        source = "(SELECT service_id FROM calendar UNION ALL SELECT service_id FROM calendar_dates)" if parent == "calendar" else parent
        parts.append(f"SELECT 'foreign_key_violation' AS code, 'ERROR' AS severity, csv_row, '{child}.txt' AS child, '{column}' AS field, '{parent}.txt' AS parent, {column} AS value FROM {child} c WHERE {column} <> '' AND NOT EXISTS (SELECT 1 FROM {source} p WHERE p.{key} = c.{column})")
    return " UNION ALL ".join(parts)


ORACLES["j1_foreign_key_violations"] = f"{prelude(*_STAR)} {_foreign_keys()}"
ORACLES["j2_dangling_services"] = f"""{prelude('trips.txt', 'calendar.txt', 'calendar_dates.txt')}
SELECT csv_row, service_id FROM trips t WHERE NOT EXISTS (SELECT 1 FROM calendar c WHERE c.service_id = t.service_id) AND NOT EXISTS (SELECT 1 FROM calendar_dates c WHERE c.service_id = t.service_id)"""
ORACLES["j3_wrong_parent_kinds"] = f"""{prelude('stops.txt')}
SELECT 'station_with_parent_station' AS code, 'ERROR' AS severity, csv_row, parent_station AS parent, NULL::VARCHAR AS kind, NULL::VARCHAR AS parent_kind FROM stops WHERE location_type = '1' AND parent_station <> ''
UNION ALL
SELECT 'wrong_parent_location_type', 'ERROR', c.csv_row, c.parent_station, c.location_type, p.location_type
FROM stops c JOIN stops p ON p.stop_id = c.parent_station
WHERE c.location_type <> '1' AND p.location_type <> CASE WHEN c.location_type = '4' THEN '0' ELSE '1' END"""
ORACLES["j4_unusable_trips_missing"] = f"{prelude('trips.txt', 'stop_times.txt')} SELECT trip_id, csv_row FROM trips t WHERE NOT EXISTS (SELECT 1 FROM stop_times s WHERE s.trip_id = t.trip_id)"
ORACLES["j5_single_or_unused_shapes"] = """WITH g AS (SELECT (event_id * 7919 % 9001)::VARCHAR AS shape_id, count(*) AS n, min(event_id) + 2 AS csv_row FROM events GROUP BY 1)
SELECT 'single_shape_point' AS code, 'WARNING' AS severity, csv_row, shape_id AS shape FROM g WHERE n = 1
UNION ALL SELECT 'unused_shape', 'WARNING', csv_row, shape_id FROM g WHERE shape_id NOT IN (SELECT o_custkey::VARCHAR FROM orders)"""
ORACLES["j5_unused_shapes"] = f"""{prelude('shapes.txt', 'trips.txt')},
g AS (SELECT shape_id, count(*) AS n, arg_min(csv_row, shape_pt_sequence::BIGINT) AS csv_row FROM shapes GROUP BY shape_id)
SELECT 'single_shape_point' AS code, 'WARNING' AS severity, csv_row, shape_id AS shape FROM g WHERE n = 1
UNION ALL SELECT 'unused_shape', 'WARNING', csv_row, shape_id FROM g WHERE shape_id NOT IN (SELECT shape_id FROM trips)"""

_SECONDS = "(split_part({0}, ':', 1)::BIGINT * 3600 + split_part({0}, ':', 2)::BIGINT * 60 + split_part({0}, ':', 3)::BIGINT)"


def _seconds(c: str) -> str:
    return f"(CASE WHEN {c} <> '' THEN {_SECONDS.format(c)} END)"


_PARSED = f"""st AS (SELECT csv_row, trip_id, stop_sequence::BIGINT AS seq, {_seconds('arrival_time')} AS arrival, {_seconds('departure_time')} AS departure, arrival_time <> '' AS arrival_set, departure_time <> '' AS departure_set,
timepoint = '1' AS timepoint, shape_dist_traveled::DOUBLE AS distance FROM stop_times),
pr AS (SELECT *, count(*) OVER (PARTITION BY trip_id) AS stops, row_number() OVER (PARTITION BY trip_id ORDER BY seq, csv_row) AS place,
last_value(departure IGNORE NULLS) OVER w AS prev_departure, last_value(CASE WHEN departure IS NOT NULL THEN csv_row END IGNORE NULLS) OVER w AS prev_row, last_value(distance IGNORE NULLS) OVER w AS prev_distance
FROM st WINDOW w AS (PARTITION BY trip_id ORDER BY seq, csv_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_SPANS = """sp AS (SELECT trip_id, count(*) AS stops, arg_min(coalesce(arrival, departure), seq * 1e18::HUGEINT + csv_row) FILTER (WHERE coalesce(arrival, departure) IS NOT NULL) AS first_s,
arg_max(coalesce(departure, arrival), seq * 1e18::HUGEINT + csv_row) FILTER (WHERE coalesce(departure, arrival) IS NOT NULL) AS last_s, arg_min(csv_row, seq * 1e18::HUGEINT + csv_row) AS first_row FROM st GROUP BY trip_id)"""

_DATES = """raw_days AS (
    SELECT DISTINCT c.service_id, d::DATE AS day FROM calendar c, unnest(generate_series(strptime(start_date, '%Y%m%d'), strptime(end_date, '%Y%m%d'), INTERVAL 1 DAY)) t(d)
    WHERE CASE isodow(d) WHEN 1 THEN monday WHEN 2 THEN tuesday WHEN 3 THEN wednesday WHEN 4 THEN thursday WHEN 5 THEN friday WHEN 6 THEN saturday ELSE sunday END = '1'
),
exc AS (SELECT service_id, strptime(date, '%Y%m%d')::DATE AS day, arg_max(exception_type, csv_row) AS type FROM calendar_dates GROUP BY ALL),
days AS (
    SELECT service_id, day FROM raw_days r WHERE NOT EXISTS (SELECT 1 FROM exc e WHERE e.service_id = r.service_id AND e.day = r.day AND e.type = '2')
    UNION SELECT service_id, day FROM exc WHERE type = '1'
)"""

ORACLES["j7_block_overlaps"] = f"""{prelude('trips.txt', 'stop_times.txt', 'calendar.txt', 'calendar_dates.txt')},
{_PARSED}, {_SPANS}, {_DATES},
m AS (SELECT t.block_id, t.trip_id, t.service_id, first_s AS a, last_s AS b, first_row, row_number() OVER (PARTITION BY block_id ORDER BY first_s, t.csv_row) - 1 AS i, count(*) OVER (PARTITION BY block_id) AS n
      FROM trips t JOIN sp USING (trip_id) WHERE sp.stops >= 2 AND first_s IS NOT NULL AND last_s IS NOT NULL),
pairs AS (SELECT x.block_id, x.trip_id AS trip_a, y.trip_id AS trip_b, y.first_row AS row_b, x.service_id AS service_a, y.service_id AS service_b, k AS shift
      FROM m x JOIN m y ON x.block_id = y.block_id AND x.i < y.i CROSS JOIN (SELECT unnest(generate_series(-7, 7)) AS k)
      WHERE k BETWEEN -least(y.b // 86400 + 1, 7) AND least(x.b // 86400 + 1, 7) AND x.a - 86400 * k < y.b AND y.a < x.b - 86400 * k AND x.i * (x.n - 1) - (x.i * (x.i - 1)) // 2 + (y.i - x.i) <= 10000)
SELECT DISTINCT block_id, trip_a, trip_b, row_b FROM pairs p
WHERE EXISTS (SELECT 1 FROM days d JOIN days e ON e.day = d.day + p.shift::INTEGER WHERE d.service_id = p.service_a AND e.service_id = p.service_b)"""
ORACLES["j8_shared_service_days"] = f"""{prelude('calendar.txt', 'calendar_dates.txt')}, {_DATES}
SELECT DISTINCT a.service_id AS service_a, b.service_id AS service_b, k::INTEGER AS shift
FROM days a JOIN days b ON a.service_id < b.service_id CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k) WHERE b.day = a.day + k::INTEGER"""
_HAVERSINE = "2 * 6371008.8 * asin(sqrt(pow(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin((radians({3}) - radians({1})) / 2), 2)))"
ORACLES["j16_nearest_nodes"] = f"""
WITH n AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 9000)::DOUBLE / 1000 AS lat, (s_suppkey * 91 % 9000)::DOUBLE / 1000 AS lon FROM supplier),
p AS (SELECT n_nationkey::BIGINT AS point_id, (n_nationkey * 531 % 9000)::DOUBLE / 1000 AS lat, (n_nationkey * 777 % 9000)::DOUBLE / 1000 AS lon FROM nation),
d AS (SELECT point_id, id, {_HAVERSINE.format('p.lat', 'p.lon', 'n.lat', 'n.lon')} AS d FROM p CROSS JOIN n)
SELECT point_id, id, round(d, 3) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, id) AS k FROM d) WHERE k = 1"""
ORACLES["s_duplicate_keys"] = f"""{prelude('stop_times.txt')},
k AS (SELECT csv_row, trip_id, stop_sequence, min(csv_row) OVER (PARTITION BY trip_id, stop_sequence) AS first_row FROM stop_times)
SELECT csv_row, first_row, trip_id, stop_sequence FROM k WHERE csv_row > first_row"""
_ST = prelude("stop_times.txt")
ORACLES["a3_unusable_trips_short"] = f"{_ST}, {_PARSED} SELECT trip_id, csv_row FROM pr WHERE stops < 2"
ORACLES["a4_trip_spans"] = f"{_ST}, {_PARSED}, {_SPANS} SELECT trip_id, first_s, last_s, first_row FROM sp WHERE stops >= 2 AND first_s IS NOT NULL AND last_s IS NOT NULL"
_CAL = prelude("calendar.txt", "calendar_dates.txt")
ORACLES["a5_service_window"] = f"{_CAL}, {_DATES} SELECT strftime(min(day), '%Y%m%d') AS first_day, strftime(max(day), '%Y%m%d') AS last_day FROM days"
ORACLES["a6_expired_services"] = "SELECT o_custkey::VARCHAR AS service_id, strftime(max(o_orderdate), '%Y%m%d') AS last_day FROM orders GROUP BY o_custkey HAVING max(o_orderdate) < DATE '2001-03-01'"
ORACLES["a6_expired_calendars"] = f"{_CAL}, {_DATES} SELECT service_id, strftime(max(day), '%Y%m%d') AS last_day FROM days GROUP BY service_id HAVING max(day) < DATE '2001-07-30'"
ORACLES["u2_service_dates"] = f"{_CAL}, {_DATES} SELECT service_id, strftime(day, '%Y%m%d') AS day FROM days"
ORACLES["w1_stop_time_notices"] = f"""{_ST}, {_PARSED}
SELECT code, 'ERROR' AS severity, csv_row, trip_id AS trip, field, prev::VARCHAR AS prev FROM (
SELECT 'unusable_trip' AS code, csv_row, trip_id, NULL AS field, NULL AS prev FROM pr WHERE stops < 2
UNION ALL SELECT 'missing_trip_edge', csv_row, trip_id, 'arrival_time', NULL FROM pr WHERE stops >= 2 AND place IN (1, stops) AND NOT arrival_set
UNION ALL SELECT 'missing_trip_edge', csv_row, trip_id, 'departure_time', NULL FROM pr WHERE stops >= 2 AND place IN (1, stops) AND NOT departure_set
UNION ALL SELECT 'departure_before_arrival', csv_row, trip_id, NULL, NULL FROM pr WHERE stops >= 2 AND departure < arrival
UNION ALL SELECT 'stop_time_timepoint_without_times', csv_row, trip_id, NULL, NULL FROM pr WHERE stops >= 2 AND timepoint AND NOT (arrival_set AND departure_set)
UNION ALL SELECT 'stop_time_with_only_arrival_or_departure_time', csv_row, trip_id, NULL, NULL FROM pr WHERE stops >= 2 AND arrival_set <> departure_set
UNION ALL SELECT 'stop_time_with_arrival_before_previous_departure_time', csv_row, trip_id, NULL, prev_row FROM pr WHERE stops >= 2 AND arrival < prev_departure
UNION ALL SELECT 'decreasing_or_equal_stop_time_distance', csv_row, trip_id, NULL, NULL FROM pr WHERE stops >= 2 AND distance <= prev_distance)"""
ORACLES["w5_arrival_before_previous_departure"] = f"{_ST}, {_PARSED} SELECT trip_id, csv_row, prev_row FROM pr WHERE stops >= 2 AND arrival < prev_departure"
ORACLES["w6_distance_not_growing"] = f"{_ST}, {_PARSED} SELECT trip_id, csv_row FROM pr WHERE stops >= 2 AND distance <= prev_distance"
ORACLES["w8_overlapping_frequencies"] = f"""{prelude('frequencies.txt')},
f AS (SELECT trip_id, csv_row, {_seconds('start_time')} AS a, {_seconds('end_time')} AS b FROM frequencies),
o AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY a, b, csv_row) AS k FROM f),
r AS (SELECT *, max(b) OVER w AS furthest FROM o WINDOW w AS (PARTITION BY trip_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_reach AS (SELECT trip_id, b, min(k) AS k FROM o GROUP BY ALL)
SELECT 'overlapping_frequency' AS code, 'ERROR' AS severity, r.csv_row, r.trip_id AS trip, p.csv_row::VARCHAR AS prev
FROM r JOIN first_reach q ON q.trip_id = r.trip_id AND q.b = r.furthest JOIN o p ON p.trip_id = r.trip_id AND p.k = q.k WHERE r.a < r.furthest"""
ORACLES["w9_shape_distances"] = f"""{prelude('shapes.txt')},
p AS (SELECT shape_id, csv_row, shape_dist_traveled::DOUBLE AS d, shape_pt_lat::DOUBLE AS lat, shape_pt_lon::DOUBLE AS lon, lag(shape_dist_traveled::DOUBLE) OVER w AS pd, lag(shape_pt_lat::DOUBLE) OVER w AS plat, lag(shape_pt_lon::DOUBLE) OVER w AS plon, lag(csv_row) OVER w AS prev_row
      FROM shapes WINDOW w AS (PARTITION BY shape_id ORDER BY shape_pt_sequence::BIGINT, csv_row))
SELECT shape_id, csv_row, prev_row, CASE WHEN d < pd THEN 'less' WHEN lat = plat AND lon = plon THEN 'same' ELSE 'moved' END AS relation FROM p WHERE d <= pd"""
ORACLES["w14_block_pair_numbers"] = f"""{prelude('trips.txt', 'stop_times.txt')}, {_PARSED}, {_SPANS},
m AS (SELECT t.block_id, row_number() OVER (PARTITION BY block_id ORDER BY first_s, t.csv_row) - 1 AS i, count(*) OVER (PARTITION BY block_id) AS n FROM trips t JOIN sp USING (trip_id) WHERE sp.stops >= 2 AND first_s IS NOT NULL AND last_s IS NOT NULL)
SELECT x.block_id, x.i AS i_a, y.i AS i_b, row_number() OVER (PARTITION BY x.block_id ORDER BY x.i, y.i) AS number FROM m x JOIN m y ON x.block_id = y.block_id AND x.i < y.i"""
ORACLES["w15_idle_services"] = """SELECT 'service_has_no_active_day_of_the_week' AS code, 'WARNING' AS severity, o_custkey + 2 AS csv_row, o_custkey::VARCHAR AS service FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') = 0"""
ORACLES["w19_cumulative_distance"] = f"""
WITH p AS (SELECT user_id, event_id, (event_id * 13 % 9500)::DOUBLE / 100 AS lat, (event_id * 29 % 18500)::DOUBLE / 100 AS lon FROM events),
s AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round(sum(coalesce({_HAVERSINE.format('plat', 'plon', 'lat', 'lon')}, 0)) OVER (PARTITION BY user_id ORDER BY event_id), 2) AS along_m FROM s"""
ORACLES["a13_modes_served"] = "SELECT DISTINCT mode FROM (SELECT CASE " + " ".join(f"WHEN k BETWEEN {a} AND {b} THEN '{m}'" for m, ranges in modes.MODES.items() for a, b in ranges) + " END AS mode FROM (SELECT p_size * 27 AS k FROM part)) WHERE mode IS NOT NULL"
ORACLES["x_route_modes"] = "SELECT p_partkey, k::BIGINT AS route_type, CASE " + " ".join(f"WHEN k BETWEEN {a} AND {b} THEN '{m}'" for m, ranges in modes.MODES.items() for a, b in ranges) + " END AS mode FROM (SELECT p_partkey, p_size * 27 AS k FROM part)"
ORACLES["a16_polylines"] = f"""{prelude('shapes.txt')}
SELECT shape_id, CASE WHEN count(*) >= 2 THEN count(*) END AS points, CASE WHEN count(*) >= 2 THEN arg_min(shape_pt_lat::DOUBLE, shape_pt_sequence::BIGINT) END AS first_lat, CASE WHEN count(*) >= 2 THEN arg_max(shape_pt_lon::DOUBLE, shape_pt_sequence::BIGINT) END AS last_lon FROM shapes GROUP BY shape_id"""

# Field rules: one SELECT for each code over csv_row and value.


def _cells(source: str, *rules: tuple[str, str, str]) -> str:
    return f"WITH v AS ({source}) " + " UNION ALL ".join(f"SELECT '{code}' AS code, '{severity}' AS severity, csv_row, value FROM v WHERE {where}" for code, severity, where in rules)


_SPACES = "value <> '' AND (regexp_matches(value, '^\\s') OR regexp_matches(value, '\\s$'))"
ORACLES["f_required_and_whitespace"] = _cells(
    "SELECT p_partkey AS csv_row, CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN ' ' || p_name WHEN 2 THEN p_name || chr(9) WHEN 3 THEN p_name || chr(10) || p_type ELSE p_name END AS value FROM part",
    ("missing_required_field", "ERROR", "value = ''"), ("leading_or_trailing_whitespaces", "WARNING", _SPACES), ("new_line_in_value", "WARNING", "contains(value, chr(10)) OR contains(value, chr(13))"),
)
ORACLES["f_dates"] = _cells(
    "SELECT o_orderkey AS csv_row, CASE o_orderkey % 3 WHEN 0 THEN left(strftime(o_orderdate, '%Y%m%d'), 6) || (20 + o_orderkey % 15)::VARCHAR WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y%m%d') END AS value FROM orders",
    ("invalid_date", "ERROR", "NOT regexp_full_match(value, '[0-9]{8}') OR try_strptime(value, '%Y%m%d') IS NULL"),
)
ORACLES["f_times"] = _cells(
    "SELECT o_orderkey AS csv_row, (o_orderkey % 130)::VARCHAR || ':' || lpad((o_orderkey % 70)::VARCHAR, 2, '0') || ':' || (o_orderkey % 65)::VARCHAR AS value FROM orders",
    ("invalid_time", "ERROR", "NOT regexp_full_match(value, '[0-9]{1,3}:[0-5][0-9]:[0-5][0-9]')"),
)
ORACLES["f_integers"] = _cells(
    "SELECT c_custkey AS csv_row, CASE c_custkey % 5 WHEN 0 THEN '+' || c_custkey::VARCHAR WHEN 1 THEN '-' || c_custkey::VARCHAR WHEN 2 THEN c_acctbal::VARCHAR ELSE c_custkey::VARCHAR END AS value FROM customer",
    ("invalid_integer", "ERROR", "NOT regexp_full_match(value, '[+-]?[0-9]+')"), ("number_out_of_range", "ERROR", "regexp_full_match(value, '[+-]?[0-9]+') AND replace(CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN value ELSE '5' END, '+', '')::BIGINT NOT BETWEEN 3 AND 1000"),
)
ORACLES["f_floats"] = _cells(
    "SELECT c_custkey AS csv_row, c_custkey % 6 AS k, c_custkey AS c, CASE c_custkey % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN c_custkey::VARCHAR || 'd' WHEN 2 THEN '.' || c_custkey::VARCHAR || 'e2' WHEN 3 THEN '-inf' ELSE (c_custkey * 10)::VARCHAR END AS value FROM customer",
    ("invalid_float", "ERROR", "k = 1"), ("number_out_of_range", "ERROR", "k IN (0, 3) OR (k > 3 AND c * 10 > 5000)"),
)
ORACLES["f_enumerations"] = _cells(
    "SELECT p_partkey AS csv_row, p_size, CASE WHEN p_size % 7 = 0 THEN p_type ELSE p_size::VARCHAR END AS value FROM part",
    ("invalid_integer", "ERROR", "p_size % 7 = 0"), ("unexpected_enum_value", "WARNING", "p_size % 7 <> 0 AND p_size NOT IN (1, 2, 3, 5, 8, 13, 21, 34)"),
)
_COORDINATES = " UNION ALL ".join(f"SELECT 'number_out_of_range' AS code, 'ERROR' AS severity, csv_row, '{c}' AS field, {c} AS value FROM stops WHERE {c} <> '' AND abs({c}::DOUBLE) > {most}" for c, most in (("stop_lat", 90), ("stop_lon", 180)))
ORACLES["f_coordinates"] = f"{prelude('stops.txt')} {_COORDINATES} UNION ALL SELECT 'unexpected_enum_value', 'WARNING', csv_row, 'location_type', location_type FROM stops WHERE location_type = '5'"
ORACLES["f_zones"] = f"{prelude('agency.txt')} SELECT 'missing_required_field' AS code, 'ERROR' AS severity, csv_row, 'agency_url' AS field, '' AS value FROM agency UNION ALL SELECT 'invalid_timezone', 'ERROR', csv_row, 'agency_timezone', agency_timezone FROM agency WHERE agency_timezone = 'Europe/Nowhere'"

_STOP_PLACES = """SELECT 'stop_without_location' AS code, 'ERROR' AS severity, csv_row, stop_id AS stop, stop_lat, stop_lon FROM stops WHERE (location_type NOT IN ('3', '4', '5')) AND stop_lat = ''
UNION ALL SELECT CASE WHEN abs(stop_lat::DOUBLE) <= 1 AND abs(stop_lon::DOUBLE) <= 1 THEN 'point_near_origin' ELSE 'point_near_pole' END, 'WARNING', csv_row, NULL, stop_lat, stop_lon FROM (SELECT * FROM stops WHERE stop_lat <> '')
WHERE (abs(stop_lat::DOUBLE) <= 1 AND abs(stop_lon::DOUBLE) <= 1) OR abs(stop_lat::DOUBLE) >= 89"""
ORACLES["c_stop_places"] = f"{prelude('stops.txt')} SELECT code, severity, csv_row, stop FROM ({_STOP_PLACES})"
ORACLES["c_stop_time_places"] = """SELECT 'missing_required_field' AS code, 'ERROR' AS severity, o_orderkey AS csv_row, 'stop_id' AS field FROM orders WHERE o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0
UNION ALL SELECT 'forbidden_geography_id', 'ERROR', o_orderkey, NULL FROM orders WHERE o_orderkey % 6 = 0"""
ORACLES["c_transfer_times"] = f"{prelude('transfers.txt')} SELECT 'missing_required_field' AS code, 'ERROR' AS severity, csv_row, 'min_transfer_time' AS field FROM transfers WHERE transfer_type = '2' AND min_transfer_time = ''"
ORACLES["c_route_rules"] = f"{prelude('routes.txt')} SELECT 'route_both_short_and_long_name_missing' AS code, 'ERROR' AS severity, csv_row, route_id AS route FROM routes WHERE trim(route_short_name) = '' AND route_long_name = ''"
ORACLES["c_agency_zones"] = f"{prelude('agency.txt')} SELECT 'inconsistent_agency_timezone' AS code, 'ERROR' AS severity, csv_row, 'Europe/Berlin' AS expected, agency_timezone AS actual FROM agency WHERE agency_timezone <> 'Europe/Berlin'"
ORACLES["c_ranges"] = f"""{prelude('frequencies.txt')},
a AS (SELECT csv_row, start_time AS s, CASE WHEN csv_row % 7 = 0 THEN start_time ELSE end_time END AS e FROM frequencies),
b AS (SELECT csv_row, CASE WHEN csv_row % 11 = 0 THEN e ELSE s END AS s, CASE WHEN csv_row % 11 = 0 THEN s ELSE e END AS e FROM a),
c AS (SELECT csv_row, {_seconds('s')} AS s, {_seconds('e')} AS e FROM b)
SELECT 'start_and_end_range_out_of_order' AS code, 'ERROR' AS severity, csv_row FROM c WHERE s > e UNION ALL SELECT 'start_and_end_range_equal', 'WARNING', csv_row FROM c WHERE s = e"""

# The notices that quotas and reports are shown with.
_ALL = f"""{prelude('stops.txt', 'trips.txt', 'routes.txt', 'transfers.txt', 'agency.txt')},
notice AS (
    SELECT 'agency.txt' AS file, 0 AS pass, csv_row, 2 * 8 AS place, 'missing_required_field' AS code, 'ERROR' AS severity FROM agency
    UNION ALL SELECT 'agency.txt', 0, csv_row, 3 * 8 + 3, 'invalid_timezone', 'ERROR' FROM agency WHERE agency_timezone = 'Europe/Nowhere'
    UNION ALL SELECT 'routes.txt', 0, csv_row, 2 * 8 + 1, 'leading_or_trailing_whitespaces', 'WARNING' FROM routes WHERE route_short_name = ' '
    UNION ALL SELECT 'routes.txt', 0, csv_row, 4 * 8 + 4, 'unexpected_enum_value', 'WARNING' FROM routes WHERE route_type::INTEGER NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 11, 12)
    UNION ALL SELECT 'stops.txt', 0, csv_row, 2 * 8 + 4, 'number_out_of_range', 'ERROR' FROM stops WHERE stop_lat <> '' AND abs(stop_lat::DOUBLE) > 90
    UNION ALL SELECT 'stops.txt', 0, csv_row, 3 * 8 + 4, 'number_out_of_range', 'ERROR' FROM stops WHERE abs(stop_lon::DOUBLE) > 180
    UNION ALL SELECT 'stops.txt', 0, csv_row, 4 * 8 + 4, 'unexpected_enum_value', 'WARNING' FROM stops WHERE location_type = '5'
    UNION ALL SELECT 'trips.txt', 0, csv_row, 6 * 8 + 4, 'unexpected_enum_value', 'WARNING' FROM trips WHERE wheelchair_accessible IN ('3', '4')
    UNION ALL SELECT 'stops.txt', 1, csv_row, CASE code WHEN 'stop_without_location' THEN 0 WHEN 'point_near_origin' THEN 1 ELSE 2 END, code, severity FROM ({_STOP_PLACES})
    UNION ALL SELECT 'transfers.txt', 1, csv_row, 0, 'missing_required_field', 'ERROR' FROM transfers WHERE transfer_type = '2' AND min_transfer_time = ''
)"""
ORACLES["w20_sampled_notices"] = f"""{_ALL},
k AS (SELECT *, row_number() OVER (PARTITION BY file, severity = 'ERROR' ORDER BY pass, csv_row, place, code) AS rank FROM notice),
lost AS (SELECT file, severity = 'ERROR' AS grave, count(*) - 25 AS n FROM notice GROUP BY ALL HAVING count(*) > 25)
SELECT code, severity, csv_row, NULL::VARCHAR AS suppressed FROM k WHERE rank <= 25
UNION ALL SELECT 'notice_limit_reached', CASE WHEN bool_or(grave) THEN 'ERROR' ELSE 'WARNING' END, NULL, sum(n)::BIGINT::VARCHAR FROM lost GROUP BY file"""
_GROUPS = "groups AS (SELECT code, arg_min(severity, (pass, file, csv_row, place)) AS severity, count(*) AS total FROM notice GROUP BY code)"
ORACLES["a9_notices_by_code"] = f"{_ALL}, {_GROUPS} SELECT code, severity, total, least(total, 50) AS samples FROM groups"
_MERGED = f"""{_GROUPS},
hosted AS (SELECT CASE p_size % 4 WHEN 0 THEN 'number_out_of_range' WHEN 1 THEN 'point_near_origin' WHEN 2 THEN 'hosted_only' ELSE 'unexpected_enum_value' END AS code, count(*) AS total FROM part GROUP BY 1),
merged AS (SELECT coalesce(g.code, h.code) AS code, coalesce(g.severity, 'WARNING') AS severity, CASE WHEN g.code IS NULL THEN 'hosted' WHEN h.code IS NULL THEN 'local' ELSE 'both' END AS source, coalesce(g.total, h.total) AS total, coalesce(g.total, 0) AS local_total, h.total AS hosted_total
           FROM groups g FULL JOIN hosted h ON g.code = h.code)"""
ORACLES["a10_severity_totals"] = f"{_ALL}, {_MERGED} SELECT " + ", ".join(f"coalesce(sum(total) FILTER (WHERE source <> 'hosted' AND severity = '{s}'), 0)::BIGINT AS {n}" for s, n in (("ERROR", "errors"), ("WARNING", "warnings"), ("INFO", "infos"))) + " FROM merged"
ORACLES["j13_merged_report"] = f"{_ALL}, {_MERGED} SELECT * FROM merged"
ORACLES["j14_parity"] = f"{_ALL}, {_MERGED} SELECT code, CASE source WHEN 'local' THEN 'local_only' WHEN 'hosted' THEN 'hosted_only' ELSE CASE WHEN local_total = hosted_total THEN 'agreeing' ELSE 'count_disagreement' END END AS bucket, local_total, coalesce(hosted_total, 0) AS hosted_total FROM merged"
ORACLES["l5_report_order"] = f"{_ALL}, {_MERGED} SELECT code, row_number() OVER (ORDER BY CASE severity WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END, total + coalesce(hosted_total, 0) DESC, code) AS place FROM merged"

# Crop, repair, edits.
_INSIDE = "inside AS (SELECT stop_id FROM stops WHERE stop_lat <> '' AND stop_lat::DOUBLE BETWEEN 15 AND 60 AND stop_lon::DOUBLE BETWEEN 20 AND 150)"
ORACLES["j9_crop_trips_in_area"] = f"{prelude('trips.txt', 'stop_times.txt', 'stops.txt')}, {_INSIDE} SELECT DISTINCT trip_id FROM trips WHERE trip_id IN (SELECT trip_id FROM stop_times WHERE stop_id IN (SELECT stop_id FROM inside))"
ORACLES["a14_crop_trips_fully_inside"] = f"{prelude('trips.txt', 'stop_times.txt', 'stops.txt')}, {_INSIDE} SELECT DISTINCT trip_id FROM trips WHERE trip_id IN (SELECT trip_id FROM stop_times) AND trip_id NOT IN (SELECT trip_id FROM stop_times WHERE stop_id NOT IN (SELECT stop_id FROM inside))"
ORACLES["j9_crop_trips_in_window"] = f"{prelude('trips.txt', 'calendar.txt', 'calendar_dates.txt')}, {_DATES} SELECT DISTINCT trip_id FROM trips WHERE service_id IN (SELECT service_id FROM days WHERE day >= DATE '2001-07-30')"
ORACLES["j10_crop_cascade_counts"] = f"""{prelude(*_STAR)}, {_INSIDE}, {_DATES},
kept AS (SELECT DISTINCT trip_id FROM trips WHERE trip_id IN (SELECT trip_id FROM stop_times WHERE stop_id IN (SELECT stop_id FROM inside)) AND service_id IN (SELECT service_id FROM days WHERE day BETWEEN DATE '1996-01-01' AND DATE '1998-01-01')),
t AS (SELECT * FROM trips WHERE trip_id IN (SELECT trip_id FROM kept)),
s AS (SELECT * FROM stop_times WHERE trip_id IN (SELECT trip_id FROM kept)),
served AS (SELECT DISTINCT stop_id FROM s),
ks AS (SELECT stop_id FROM served UNION SELECT parent_station FROM stops WHERE stop_id IN (SELECT stop_id FROM served) AND parent_station <> ''),
r AS (SELECT * FROM routes WHERE route_id IN (SELECT route_id FROM t))
SELECT 'trips' AS file, count(*) AS n FROM t UNION ALL SELECT 'stop_times', count(*) FROM s
UNION ALL SELECT 'frequencies', count(*) FROM frequencies WHERE trip_id IN (SELECT trip_id FROM kept)
UNION ALL SELECT 'stops', count(*) FROM stops WHERE stop_id IN (SELECT stop_id FROM ks)
UNION ALL SELECT 'routes', count(*) FROM r
UNION ALL SELECT 'shapes', count(*) FROM shapes WHERE shape_id IN (SELECT shape_id FROM t)
UNION ALL SELECT 'calendar', count(*) FROM calendar WHERE service_id IN (SELECT service_id FROM t) AND greatest(start_date, '19960101') <= least(end_date, '19980101')
UNION ALL SELECT 'calendar_dates', count(*) FROM calendar_dates WHERE service_id IN (SELECT service_id FROM t) AND date BETWEEN '19960101' AND '19980101'
UNION ALL SELECT 'transfers', count(*) FROM transfers WHERE from_stop_id IN (SELECT stop_id FROM ks) AND to_stop_id IN (SELECT stop_id FROM ks)
UNION ALL SELECT 'agency', count(*) FROM agency WHERE agency_id IN (SELECT agency_id FROM r) OR NOT EXISTS (SELECT 1 FROM r WHERE agency_id <> '')"""
ORACLES["t7_clamped_calendars"] = f"{prelude('calendar.txt')} SELECT service_id, greatest(start_date, '19960101') AS start_date, least(end_date, '19980101') AS end_date FROM calendar WHERE greatest(start_date, '19960101') <= least(end_date, '19980101')"
ORACLES["t3_repair_defaults"] = f"{prelude('trips.txt')} SELECT 'default_value' AS action, 'trips.txt' AS filename, csv_row, 'wheelchair_accessible' AS field, wheelchair_accessible AS old_value, '0' AS new_value, 'unexpected_enum_value' AS triggered_by FROM trips WHERE wheelchair_accessible IN ('3', '4')"
ORACLES["t4_repair_cleared_references"] = f"{prelude('trips.txt', 'shapes.txt')} SELECT trip_id, CASE WHEN shape_id IN (SELECT shape_id FROM shapes) THEN shape_id ELSE '' END AS shape_id FROM trips"
ORACLES["t6_repair_dropped_rows"] = f"{prelude('stops.txt')} SELECT stop_id, csv_row FROM stops WHERE NOT (location_type NOT IN ('3', '4', '5') AND stop_lat = '')"
ORACLES["j11_repair_cascade_round"] = f"""{prelude('stops.txt', 'trips.txt', 'routes.txt', 'stop_times.txt', 'frequencies.txt', 'transfers.txt')},
s AS (SELECT * FROM stop_times WHERE stop_id IN (SELECT stop_id FROM stops) AND trip_id IN (SELECT trip_id FROM trips)),
u AS (SELECT trip_id FROM s GROUP BY trip_id HAVING count(*) >= 2),
t AS (SELECT * FROM trips WHERE route_id IN (SELECT route_id FROM routes) AND trip_id IN (SELECT trip_id FROM u))
SELECT 'stops' AS file, count(*) AS n FROM stops UNION ALL SELECT 'routes', count(*) FROM routes UNION ALL SELECT 'stop_times', count(*) FROM s UNION ALL SELECT 'trips', count(*) FROM t
UNION ALL SELECT 'frequencies', count(*) FROM frequencies WHERE trip_id IN (SELECT trip_id FROM t)
UNION ALL SELECT 'transfers', count(*) FROM transfers WHERE from_stop_id IN (SELECT stop_id FROM stops) AND to_stop_id IN (SELECT stop_id FROM stops)"""
ORACLES["t11_updated_stop"] = f"{prelude('stops.txt')} SELECT stop_id, CASE WHEN stop_id = '1' THEN 'Main' ELSE stop_name END AS stop_name, CASE WHEN stop_id = '1' THEN 'Z' ELSE '' END AS zone_id FROM stops"
ORACLES["t12_set_headway"] = f"{prelude('frequencies.txt')} SELECT csv_row, CASE WHEN trip_id = '7' THEN '600' ELSE headway_secs END AS headway_secs, CASE WHEN trip_id = '7' THEN '23:00:00' ELSE end_time END AS end_time FROM frequencies"
_LATER = "CASE WHEN {0} = '' THEN '' ELSE format('{{:02d}}:{{:02d}}:{{:02d}}', ({1} + 86399) // 3600, ({1} + 86399) % 3600 // 60, ({1} + 86399) % 60) END"
ORACLES["t13_shifted_trip"] = f"{prelude('stop_times.txt')} SELECT csv_row, CASE WHEN trip_id::BIGINT % 100 = 0 THEN {_LATER.format('arrival_time', _seconds('arrival_time'))} ELSE arrival_time END AS arrival_time, CASE WHEN trip_id::BIGINT % 100 = 0 THEN {_LATER.format('departure_time', _seconds('departure_time'))} ELSE departure_time END AS departure_time FROM stop_times"
ORACLES["t14_dropped_route"] = f"""{prelude('routes.txt', 'trips.txt', 'stop_times.txt')}
SELECT 'routes' AS file, count(*) AS n FROM routes WHERE route_id <> '3' UNION ALL SELECT 'trips', count(*) FROM trips WHERE route_id <> '3'
UNION ALL SELECT 'stop_times', count(*) FROM stop_times WHERE trip_id NOT IN (SELECT trip_id FROM trips WHERE route_id = '3')"""
ORACLES["u5_appended_rows"] = f"""{prelude('routes.txt')}
SELECT csv_row, route_id, agency_id, route_short_name, route_long_name, route_type, '' AS route_color FROM routes
UNION ALL SELECT (SELECT max(csv_row) + 1 FROM routes), 'new', '', '', '', '3', 'FFFFFF'"""
ORACLES["t15_departures"] = """SELECT n_nationkey AS route, row_number() OVER (PARTITION BY n_nationkey ORDER BY d) AS run, d AS departure
FROM nation, unnest(generate_series(21600::BIGINT + n_nationkey * 60, 36000::BIGINT + n_regionkey * 600 - 1, 600::BIGINT + n_nationkey * 30)) t(d)"""
ORACLES["t15_stops_along"] = f"""
WITH l AS (SELECT n_nationkey::VARCHAR AS route_id, n_nationkey + 1 AS degrees, {_HAVERSINE.format('0', '0', '0', '(n_nationkey + 1)')} AS total FROM nation),
c AS (SELECT *, greatest(2, round_even(total / 40000.0, 0)::BIGINT + 1) AS stops FROM l)
SELECT route_id, n, round(degrees * n / (stops - 1), 6) AS lon, round(total * n / (stops - 1), 3) AS along_m FROM c, unnest(generate_series(0::BIGINT, stops - 1)) t(n)"""
ORACLES["u6_orphan_nodes"] = "SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_orderkey % 100 = 0 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 100 <> 0)"
ORACLES["u6_nodes_left"] = "SELECT DISTINCT l_partkey * 100 + l_quantity::BIGINT AS node FROM lineitem WHERE l_orderkey % 100 <> 0"
ORACLES["g_gaps_and_islands"] = """
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS line FROM lineitem),
g AS (SELECT *, line - row_number() OVER (PARTITION BY l_orderkey ORDER BY line) AS island FROM l)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY island) - 1 AS run, min(line) AS first_line, max(line) AS last_line FROM g GROUP BY l_orderkey, island"""

# Scalars.
ORACLES["x_time_parse"] = f"""{prelude('frequencies.txt')}, s AS (SELECT csv_row, {_seconds('start_time')} AS seconds FROM frequencies)
SELECT csv_row, seconds, format('{{:02d}}:{{:02d}}:{{:02d}}', (seconds + 90000) // 3600, (seconds + 90000) % 3600 // 60, (seconds + 90000) % 60) AS later, seconds AS lenient FROM s"""
ORACLES["x_haversine"] = f"SELECT s_suppkey, round({_HAVERSINE.format('60.17', '24.94', 'lat', 'lon')}, 3) AS metres FROM (SELECT s_suppkey, (s_suppkey * 37 % 9000)::DOUBLE / 100 AS lat, (s_suppkey * 91 % 18000)::DOUBLE / 100 AS lon FROM supplier)"
ORACLES["x_text_escapes"] = r"""WITH t AS (SELECT doc_id, text AS t FROM documents), c AS (SELECT *, CASE WHEN length(t) > 120 THEN substring(t, 1, 120) || '…' ELSE t END AS clipped FROM t)
SELECT doc_id, clipped, replace(replace(replace(replace(replace(clipped, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html,
regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM c"""
ORACLES["x_markdown"] = r"""SELECT page_id, regexp_replace(regexp_replace(CASE WHEN length(html) > 200 THEN substring(html, 1, 200) || '…' ELSE html END, '[\r\n]+', ' ', 'g'), '([\\`*_\[\]<>|])', '\\\1', 'g') AS cell FROM pages"""
ORACLES["x_safe_names"] = r"""WITH n AS (SELECT page_id, substring(url, instr(url, '://') + 3) AS name FROM pages)
SELECT page_id, name <> '' AND NOT starts_with(name, '/') AND NOT regexp_matches(name, '^[A-Za-z]:') AND len(list_filter(string_split(name, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS member,
regexp_full_match(regexp_replace(name, '/.*', ''), '[A-Za-z0-9_-][A-Za-z0-9._-]*') AS id FROM n"""

# Catalogue.
_FEEDS = """f AS (SELECT s_suppkey::VARCHAR AS id, s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 'inactive' ELSE 'active' END AS status, s_acctbal > 5000 AS official,
CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey % 90 END AS west, CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey % 40 END AS south, CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey % 90 + s_nationkey END AS east, CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey % 40 + 5 END AS north FROM supplier)"""
ORACLES["t18_catalog_search"] = f"WITH {_FEEDS} SELECT id, official FROM f WHERE status = 'active' AND west <= 60 AND east >= 10 AND south <= 30 AND north >= 5"
ORACLES["t18_catalog_country"] = f"WITH {_FEEDS} SELECT id, status FROM f WHERE s_nationkey = 7 AND west >= 0 AND east <= 95 AND south >= 0 AND north <= 50"
ORACLES["l2_ranked_feeds"] = f"WITH {_FEEDS} SELECT id, row_number() OVER (ORDER BY official DESC, (status = 'active') DESC, (west IS NULL), abs(east - west) * abs(north - south), id) AS place FROM f QUALIFY place <= 10"
ORACLES["l3_dataset_for_day"] = "SELECT o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y%m%d') AS first_day FROM orders WHERE o_orderdate::DATE <= DATE '1998-03-01' AND (o_orderkey % 2 <> 0 OR o_orderdate::DATE + 60 >= DATE '1998-03-01') ORDER BY o_orderdate DESC, id LIMIT 1"

# The flagship: everything, counted by code.
_COUNTED = f"""SELECT 'keys' AS stage, 'duplicate_key' AS code, 'ERROR' AS severity FROM (SELECT row_number() OVER (PARTITION BY trip_id, stop_sequence ORDER BY csv_row) AS k FROM stop_times) WHERE k > 1
UNION ALL SELECT 'keys', 'duplicate_key', 'ERROR' FROM (SELECT row_number() OVER (PARTITION BY service_id, date ORDER BY csv_row) AS k FROM calendar_dates) WHERE k > 1
UNION ALL SELECT 'keys', 'duplicate_key', 'ERROR' FROM (SELECT row_number() OVER (PARTITION BY trip_id, start_time ORDER BY csv_row) AS k FROM frequencies) WHERE k > 1
UNION ALL SELECT 'rules', code, severity FROM notice
UNION ALL SELECT 'rules', 'number_out_of_range', 'ERROR' FROM frequencies WHERE headway_secs = '0'
UNION ALL SELECT 'rules', 'number_out_of_range', 'ERROR' FROM shapes WHERE shape_pt_lat::DOUBLE > 90
UNION ALL SELECT 'rules', 'number_out_of_range', 'ERROR' FROM shapes WHERE shape_pt_lon::DOUBLE > 180
UNION ALL SELECT 'rules', 'route_both_short_and_long_name_missing', 'ERROR' FROM routes WHERE trim(route_short_name) = '' AND route_long_name = ''
UNION ALL SELECT 'rules', 'inconsistent_agency_timezone', 'ERROR' FROM agency WHERE agency_timezone <> 'Europe/Berlin'
UNION ALL SELECT 'rules', 'start_and_end_range_out_of_order', 'ERROR' FROM frequencies WHERE {_seconds('start_time')} > {_seconds('end_time')}
UNION ALL SELECT 'rules', 'start_and_end_range_equal', 'WARNING' FROM frequencies WHERE {_seconds('start_time')} = {_seconds('end_time')}
UNION ALL SELECT 'rules', 'missing_required_field', 'ERROR' FROM stops WHERE location_type IN ('2', '3', '4') AND parent_station = ''"""


def _flagship() -> str:
    def inner(name: str) -> str:
        """The query's own body, behind the shared tables."""
        return ORACLES[name]

    parts = [f"SELECT 'rules' AS stage, code, severity FROM ({inner('j3_wrong_parent_kinds')})", f"SELECT 'rules', code, severity FROM ({inner('j1_foreign_key_violations')})"]
    parts += [f"SELECT 'semantics', code, severity FROM ({inner(n)})" for n in ("w1_stop_time_notices", "w8_overlapping_frequencies", "j5_unused_shapes")]
    parts += [f"SELECT 'semantics', 'unusable_trip', 'ERROR' FROM ({inner('j4_unusable_trips_missing')})", f"SELECT 'semantics', 'block_trips_with_overlapping_stop_times', 'ERROR' FROM ({inner('j7_block_overlaps')})", f"SELECT 'semantics', 'expired_calendar', 'WARNING' FROM ({inner('a6_expired_calendars')})"]
    parts.append(f"SELECT 'semantics', CASE relation WHEN 'less' THEN 'decreasing_shape_distance' WHEN 'same' THEN 'equal_shape_distance_same_coordinates' ELSE 'equal_shape_distance_diff_coordinates' END, CASE relation WHEN 'same' THEN 'WARNING' ELSE 'ERROR' END FROM ({inner('w9_shape_distances')})")
    idle = " AND ".join(f"{d} <> '1'" for d in spec.WEEKDAYS)
    head = _ALL.replace(prelude("stops.txt", "trips.txt", "routes.txt", "transfers.txt", "agency.txt"), prelude(*_STAR))
    parts.append(f"SELECT 'semantics', 'service_has_no_active_day_of_the_week', 'WARNING' FROM calendar WHERE {idle}")
    return f"{head} SELECT stage, code, severity, count(*) AS n FROM ({_COUNTED} UNION ALL {' UNION ALL '.join(parts)}) GROUP BY ALL"


ORACLES["t1_validate_counts"] = _flagship()
