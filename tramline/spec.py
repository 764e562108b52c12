"""The feed's files, columns, kinds of values and references."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Files of the feed format, "*" marks the required ones; then the
# required columns, then the key columns, then the optional parts of the key.
_FILES = """
agency.txt* | agency_name agency_url agency_timezone | agency_id
stops.txt* | stop_id | stop_id
routes.txt* | route_id route_type | route_id
trips.txt* | route_id service_id trip_id | trip_id
stop_times.txt* | trip_id stop_sequence | trip_id stop_sequence
calendar.txt | service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date | service_id
calendar_dates.txt | service_id date exception_type | service_id date
feed_info.txt | feed_publisher_name feed_publisher_url feed_lang |
shapes.txt | shape_id shape_pt_lat shape_pt_lon shape_pt_sequence | shape_id shape_pt_sequence
frequencies.txt | trip_id start_time end_time headway_secs | trip_id start_time
transfers.txt | transfer_type |
fare_attributes.txt | fare_id price currency_type payment_method transfers | fare_id
fare_rules.txt | fare_id | fare_id | route_id origin_id destination_id contains_id
fare_media.txt | fare_media_id fare_media_type | fare_media_id
fare_products.txt | fare_product_id amount currency | fare_product_id | rider_category_id fare_media_id
fare_leg_rules.txt | fare_product_id | fare_product_id | network_id from_area_id to_area_id from_timeframe_group_id to_timeframe_group_id
fare_leg_join_rules.txt | from_network_id to_network_id |
fare_transfer_rules.txt | fare_transfer_type |
rider_categories.txt | rider_category_id rider_category_name is_default_fare_category | rider_category_id
timeframes.txt | timeframe_group_id service_id | timeframe_group_id service_id | start_time end_time
areas.txt | area_id | area_id
stop_areas.txt | area_id stop_id | area_id stop_id
networks.txt | network_id | network_id
route_networks.txt | network_id route_id | route_id
pathways.txt | pathway_id from_stop_id to_stop_id pathway_mode is_bidirectional | pathway_id
levels.txt | level_id level_index | level_id
location_groups.txt | location_group_id | location_group_id
location_group_stops.txt | location_group_id stop_id | location_group_id stop_id
booking_rules.txt | booking_rule_id booking_type | booking_rule_id
translations.txt | table_name field_name language translation |
attributions.txt | organization_name | attribution_id
"""

# The columns of each file; "!" required, then the kind: text
# (none), date, time, zone, lat, lon, int or float with [least,most], enum[...].
_COLUMNS = """
agency.txt: agency_id agency_name! agency_url! agency_timezone!:zone agency_lang agency_phone agency_fare_url agency_email
stops.txt: stop_id! stop_code stop_name tts_stop_name stop_desc stop_lat:lat stop_lon:lon zone_id stop_url location_type:enum[0,1,2,3,4] parent_station stop_timezone:zone wheelchair_boarding:enum[0,1,2] level_id platform_code
routes.txt: route_id! agency_id route_short_name route_long_name route_desc route_type!:enum[0,1,2,3,4,5,6,7,11,12] route_url route_color route_text_color route_sort_order:int[0,] continuous_pickup:enum[0,1,2,3] continuous_drop_off:enum[0,1,2,3] network_id
trips.txt: route_id! service_id! trip_id! trip_headsign trip_short_name direction_id:enum[0,1] block_id shape_id wheelchair_accessible:enum[0,1,2] bikes_allowed:enum[0,1,2] cars_allowed:enum[0,1,2]
stop_times.txt: trip_id! arrival_time:time departure_time:time stop_id location_group_id location_id stop_sequence!:int[0,] stop_headsign start_pickup_drop_off_window:time end_pickup_drop_off_window:time pickup_type:enum[0,1,2,3] drop_off_type:enum[0,1,2,3] continuous_pickup:enum[0,1,2,3] continuous_drop_off:enum[0,1,2,3] shape_dist_traveled:float[0,] timepoint:enum[0,1] pickup_booking_rule_id drop_off_booking_rule_id
calendar.txt: service_id! monday!:enum[0,1] tuesday!:enum[0,1] wednesday!:enum[0,1] thursday!:enum[0,1] friday!:enum[0,1] saturday!:enum[0,1] sunday!:enum[0,1] start_date!:date end_date!:date
calendar_dates.txt: service_id! date!:date exception_type!:enum[1,2]
feed_info.txt: feed_publisher_name! feed_publisher_url! feed_lang! default_lang feed_start_date:date feed_end_date:date feed_version feed_contact_email feed_contact_url
shapes.txt: shape_id! shape_pt_lat!:lat shape_pt_lon!:lon shape_pt_sequence!:int[0,] shape_dist_traveled:float[0,]
frequencies.txt: trip_id! start_time!:time end_time!:time headway_secs!:int[1,] exact_times:enum[0,1]
transfers.txt: from_stop_id to_stop_id from_route_id to_route_id from_trip_id to_trip_id transfer_type!:enum[0,1,2,3,4,5] min_transfer_time:int[0,]
pathways.txt: pathway_id! from_stop_id! to_stop_id! pathway_mode!:enum[1,2,3,4,5,6,7] is_bidirectional!:enum[0,1] length:float[0,] traversal_time:int[1,] stair_count:int[,] max_slope:float[,] min_width:float[0,] signposted_as reversed_signposted_as
levels.txt: level_id! level_index!:float[,] level_name
fare_attributes.txt: fare_id! price!:float[0,] currency_type! payment_method!:enum[0,1] transfers:enum[0,1,2] agency_id transfer_duration:int[0,]
fare_rules.txt: fare_id! route_id origin_id destination_id contains_id
attributions.txt: attribution_id agency_id route_id trip_id organization_name! is_producer:enum[0,1] is_operator:enum[0,1] is_authority:enum[0,1] attribution_url attribution_email attribution_phone
translations.txt: table_name! field_name! language! translation! record_id record_sub_id field_value
"""

# Child.column -> parent.column, in the order of the checks; the
# parent "calendar.txt" of service_id stands for both calendar files.
_REFERENCES = """
trips.route_id routes.route_id
trips.service_id calendar.service_id
trips.shape_id shapes.shape_id
stop_times.trip_id trips.trip_id
stop_times.stop_id stops.stop_id
stop_times.location_group_id location_groups.location_group_id
stop_times.pickup_booking_rule_id booking_rules.booking_rule_id
stop_times.drop_off_booking_rule_id booking_rules.booking_rule_id
routes.network_id networks.network_id
stops.parent_station stops.stop_id
stops.level_id levels.level_id
routes.agency_id agency.agency_id
frequencies.trip_id trips.trip_id
transfers.from_stop_id stops.stop_id
transfers.to_stop_id stops.stop_id
transfers.from_route_id routes.route_id
transfers.to_route_id routes.route_id
transfers.from_trip_id trips.trip_id
transfers.to_trip_id trips.trip_id
pathways.from_stop_id stops.stop_id
pathways.to_stop_id stops.stop_id
fare_attributes.agency_id agency.agency_id
fare_rules.fare_id fare_attributes.fare_id
fare_rules.route_id routes.route_id
fare_rules.origin_id stops.zone_id
fare_rules.destination_id stops.zone_id
fare_rules.contains_id stops.zone_id
attributions.agency_id agency.agency_id
attributions.route_id routes.route_id
attributions.trip_id trips.trip_id
"""

#: A member that is known but never parsed.
UNPARSED = "locations.geojson"


@dataclass(frozen=True)
class FileSpec:
    name: str
    required: bool
    columns: tuple[str, ...]
    key: tuple[str, ...]
    optional_key: tuple[str, ...]


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    required: bool
    least: float | None = None
    most: float | None = None
    values: tuple[int, ...] = ()


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str
    parent_column: str


def _file(line: str) -> FileSpec:
    name, columns, key, *optional = (p.split() for p in f"{line} | ".split("|"))
    return FileSpec(name[0].rstrip("*"), name[0].endswith("*"), tuple(columns), tuple(key), tuple(optional[0]) if optional else ())


def _column(word: str) -> ColumnSpec:
    name, _, kind = word.partition(":")
    kind, _, bounds = kind.rstrip("]").partition("[")
    if kind == "enum":
        return ColumnSpec(name.rstrip("!"), kind, "!" in name, values=tuple(map(int, bounds.split(","))))
    least, _, most = bounds.partition(",")
    return ColumnSpec(name.rstrip("!"), kind or "text", "!" in name, float(least) if least else None, float(most) if most else None)


FILES = {f.name: f for f in map(_file, _FILES.strip().splitlines())}
COLUMNS = {name: tuple(map(_column, words.split())) for name, words in (line.split(":", 1) for line in _COLUMNS.strip().splitlines())}
REFERENCES = tuple(Reference(f"{a}.txt", b, f"{c}.txt", d) for a, b, c, d in (re.split(r"[ .]", line) for line in _REFERENCES.strip().splitlines()))

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
CALENDARS = ("calendar.txt", "calendar_dates.txt")


@dataclass(frozen=True)
class Budgets:
    """Limits on what one feed may hold, and on the notices kept a file."""

    max_entry_bytes: int = 1 << 30
    max_total_bytes: int = 2 << 30
    max_rows: int = 20_000_000
    max_columns: int = 1000
    max_members: int = 4096
    max_notices_per_file: int = 10_000
    reference_date: str | None = None
