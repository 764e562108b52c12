import csv
import zipfile

import pytest

from tests import feeds
from tramline import spec
from tramline.feed import from_rows
from tramline.plans.validate import validate, validate_feed
from tramline.sources import archive

DAY = spec.Budgets(reference_date="2026-06-01")


def codes(spark, tables, budgets=DAY):
    return validate(from_rows(spark, tables), budgets).codes()


def test_catalogue_has_all_files():
    assert len(spec.FILES) == 31
    assert len(spec.COLUMNS) == 17
    assert len(spec.REFERENCES) == 30
    assert spec.FILES["fare_rules.txt"].optional_key == ("route_id", "origin_id", "destination_id", "contains_id")


def test_clean_archive(spark, tmp_path):
    path = feeds.write(tmp_path / "clean.zip", feeds.clean())
    result = validate_feed(spark, path, reference_date="2026-06-01")
    assert result.codes() == {"missing_recommended_file": 1}
    assert result.service_window == ("20260101", "20261231")
    assert result.row_counts["stop_times.txt"] == 2
    assert result.as_dict()["notices"][0]["severity"] == "WARNING"


def test_structural_defects(spark, tmp_path):
    tables = feeds.clean()
    del tables["stops.txt"], tables["routes.txt"], tables["calendar.txt"]
    path = tmp_path / "bad.zip"
    feeds.write(path, tables)
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("routes.txt", "route_id,route_id,, route_type\nr,r,x,3\nr,r\n , , ,\nr\N{LATIN SMALL LETTER E WITH ACUTE},r,x,3\n".encode("latin-1"))
        z.writestr("notes.txt", "hello")
        z.writestr("nested/agency.txt", "agency_id\n")
        z.writestr("shapes.txt", "")
        z.writestr("levels.txt", "level_id,level_index\n")
    got = validate_feed(spark, str(path), reference_date="2026-06-01").codes()
    for code in (
        "missing_required_file", "missing_calendar_and_calendar_date_files", "duplicated_column", "empty_column_name", "leading_or_trailing_whitespaces", "invalid_row_length", "empty_row", "invalid_character", "unknown_file",
        "invalid_input_files_in_subfolder", "empty_file", "missing_required_column",
    ):
        assert code in got, code
    assert got["empty_file"] == 2


def test_duplicate_member_and_row_budget(spark, tmp_path):
    path = tmp_path / "twice.zip"
    feeds.write(path, feeds.clean())
    with pytest.warns(UserWarning), zipfile.ZipFile(path, "a") as z:
        z.writestr("trips.txt", "route_id,service_id,trip_id\n")
    got = validate_feed(spark, str(path), reference_date="2026-06-01").codes()
    assert got["duplicate_zip_entry"] == 1
    assert "foreign_key_violation" not in got  # the refused parent silences its checks
    short = validate_feed(spark, feeds.write(tmp_path / "short.zip", feeds.clean()), reference_date="2026-06-01", max_rows=1).codes()
    assert short["too_many_rows"] == 2
    with pytest.raises(OSError, match="not a readable"):
        (tmp_path / "no.zip").write_text("no")
        validate_feed(spark, str(tmp_path / "no.zip"))


def test_field_rules(spark):
    t = feeds.clean()
    t["calendar.txt"][0] |= {"wednesday": "9", "start_date": "2026011", "end_date": "20261232"}
    t["stop_times.txt"][0] |= {"arrival_time": "8h00", "stop_sequence": "one"}
    t["agency.txt"][0]["agency_timezone"] = "Europe/Nowhere"
    t["trips.txt"][0]["service_id"] = ""
    t["stops.txt"][0] |= {"stop_lat": "91", "stop_name": " One"}
    t["stops.txt"][1]["stop_lat"] = "x"
    got = codes(spark, t)
    for code, n in (("unexpected_enum_value", 1), ("invalid_date", 2), ("invalid_time", 1), ("invalid_integer", 1), ("invalid_timezone", 1), ("missing_required_field", 1), ("number_out_of_range", 1), ("invalid_float", 1), ("leading_or_trailing_whitespaces", 1)):
        assert got[code] == n, code


def test_conditional_and_reference_rules(spark):
    t = feeds.clean()
    t["stops.txt"] += [
        {"stop_id": "s3", "location_type": "0"}, {"stop_id": "s4", "stop_lat": "0.5", "stop_lon": "0.5"}, {"stop_id": "s5", "stop_lat": "89.5", "stop_lon": "0"}, {"stop_id": "s6", "stop_lat": "1.5", "stop_lon": "0", "location_type": "2"},
        {"stop_id": "s7", "stop_lat": "60", "stop_lon": "24", "location_type": "1", "parent_station": "s1"}, {"stop_id": "s8", "stop_lat": "60", "stop_lon": "24", "parent_station": "s1"},
    ]
    t["agency.txt"].append({"agency_id": "b", "agency_name": "B", "agency_url": "https://example.com", "agency_timezone": "UTC"})
    t["routes.txt"].append({"route_id": "r2", "route_type": "3"})
    t["stop_times.txt"].append({"trip_id": "t", "arrival_time": "08:20:00", "departure_time": "08:20:00", "stop_id": "nowhere", "stop_sequence": "3"})
    t["transfers.txt"] = [{"from_stop_id": "s1", "to_stop_id": "s2", "transfer_type": "2", "min_transfer_time": ""}]
    t["trips.txt"][0]["route_id"] = "gone"
    got = codes(spark, t)
    for code in ("stop_without_location", "point_near_origin", "point_near_pole", "station_with_parent_station", "wrong_parent_location_type", "inconsistent_agency_timezone", "route_both_short_and_long_name_missing"):
        assert got[code] == 1, code
    assert got["foreign_key_violation"] == 2
    assert got["missing_required_field"] == 3  # a parent, a transfer time, a route's agency


def test_semantics(spark):
    t = feeds.clean()
    t["calendar.txt"] += [t["calendar.txt"][0] | {"service_id": "old", "start_date": "20200101", "end_date": "20200201"}, t["calendar.txt"][0] | {"service_id": "idle", **dict.fromkeys(spec.WEEKDAYS, "0")}]
    t["calendar_dates.txt"] = [{"service_id": "wk", "date": "20260101", "exception_type": "2"}, {"service_id": "x", "date": "20270105", "exception_type": "1"}]
    t["trips.txt"] += [{"route_id": "r", "service_id": "wk", "trip_id": "late"}, {"route_id": "r", "service_id": "wk", "trip_id": "bare"}, {"route_id": "r", "service_id": "wk", "trip_id": "lone"}]
    t["stop_times.txt"] += [
        {"trip_id": "late", "arrival_time": "09:00:00", "departure_time": "09:30:00", "stop_id": "s1", "stop_sequence": "1", "shape_dist_traveled": "100"},
        {"trip_id": "late", "arrival_time": "09:10:00", "departure_time": "", "stop_id": "s2", "stop_sequence": "2", "shape_dist_traveled": "50", "timepoint": "1"},
        {"trip_id": "lone", "arrival_time": "09:10:00", "departure_time": "09:10:00", "stop_id": "s2", "stop_sequence": "1"},
    ]
    t["frequencies.txt"] = [{"trip_id": "t", "start_time": a, "end_time": b, "headway_secs": "600"} for a, b in (("08:00:00", "12:00:00"), ("09:00:00", "10:00:00"), ("11:00:00", "11:30:00"))]
    t["shapes.txt"] = [{"shape_id": s, "shape_pt_lat": lat, "shape_pt_lon": "24", "shape_pt_sequence": q, "shape_dist_traveled": d} for s, lat, q, d in (("a", "60", "1", "5"), ("a", "61", "2", "4"), ("a", "61", "3", "4"), ("a", "62", "4", "4"), ("b", "60", "1", ""))]
    feed = from_rows(spark, t)
    result = validate(feed, DAY)
    got = result.codes()
    expected = {
        "expired_calendar": 1, "service_has_no_active_day_of_the_week": 1, "unusable_trip": 2, "missing_trip_edge": 1, "stop_time_with_arrival_before_previous_departure_time": 1, "decreasing_or_equal_stop_time_distance": 1,
        "stop_time_timepoint_without_times": 1, "stop_time_with_only_arrival_or_departure_time": 1, "overlapping_frequency": 2, "decreasing_shape_distance": 1, "equal_shape_distance_same_coordinates": 1,
        "equal_shape_distance_diff_coordinates": 1, "single_shape_point": 1, "unused_shape": 2,
    }
    assert {k: got.get(k) for k in expected} == expected
    assert result.service_window == ("20200101", "20270105")


@pytest.mark.parametrize(("first", "second", "overlaps"), [(("08:00:00", "09:00:00"), ("08:30:00", "09:30:00"), 1), (("08:00:00", "09:00:00"), ("09:00:00", "10:00:00"), 0), (("25:00:00", "27:00:00"), ("01:30:00", "02:00:00"), 1)])
def test_blocks(spark, first, second, overlaps):
    t = feeds.clean()
    t["trips.txt"] = [{"route_id": "r", "service_id": "wk", "trip_id": k, "block_id": "b"} for k in ("x", "y")]
    t["stop_times.txt"] = [{"trip_id": k, "arrival_time": v, "departure_time": v, "stop_id": s, "stop_sequence": q} for k, span in (("x", first), ("y", second)) for v, s, q in zip(span, ("s1", "s2"), "12", strict=True)]
    assert codes(spark, t).get("block_trips_with_overlapping_stop_times", 0) == overlaps


def test_quota(spark):
    t = feeds.clean()
    t["stop_times.txt"] += [{"trip_id": f"z{k}", "arrival_time": "x", "departure_time": "08:00:00", "stop_id": "s1", "stop_sequence": "1"} for k in range(7)]
    result = validate(from_rows(spark, t), spec.Budgets(reference_date="2026-06-01", max_notices_per_file=3))
    limits = [r["context"] for r in result.notices.where("code = 'notice_limit_reached'").collect()]
    assert {c["filename"]: c["suppressedCount"] for c in limits}["stop_times.txt"] in ("11", "4")
    assert result.notices.where("code = 'invalid_time'").count() == 3


@pytest.mark.parametrize("rows", [3, 60_000])  # below and above the size that is read by the driver
def test_a_damaged_member_is_reported_and_the_rest_read(spark, tmp_path, rows):
    t = feeds.clean()
    t["stop_times.txt"] *= rows
    path = feeds.write(tmp_path / "feed.zip", t)
    raw = bytearray((tmp_path / "feed.zip").read_bytes())
    with zipfile.ZipFile(path) as z:
        info = z.getinfo("stop_times.txt")
        assert (info.file_size > archive.LOCAL_BYTES) == (rows > 3)
    at = info.header_offset + 30 + len("stop_times.txt") + info.compress_size // 2
    raw[at] ^= 0xFF
    (tmp_path / "bad.zip").write_bytes(raw)
    feed = archive.read(spark, str(tmp_path / "bad.zip"))
    assert "stop_times.txt" in feed.incomplete and "stop_times.txt" not in feed.tables and feed.tables["trips.txt"].count() == 1
    assert [r.file for r in feed.notices.where("code = 'unreadable_file'").collect()] == ["stop_times.txt"]


def test_a_record_that_is_no_csv(spark, tmp_path, monkeypatch):
    t = feeds.clean()
    t["stops.txt"][1]["stop_name"] = "x" * 500
    path = feeds.write(tmp_path / "feed.zip", t)
    before = csv.field_size_limit(100)
    try:
        feed = archive.read(spark, path)
        assert feed.tables["stops.txt"].count() == 1
        assert [(r.file, r.csv_row) for r in feed.notices.where("code = 'csv_parsing_failed'").collect()] == [("stops.txt", 3)]
    finally:
        csv.field_size_limit(before)
