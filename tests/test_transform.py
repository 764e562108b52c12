import zipfile

import pytest

from tests import feeds
from tramline import notices as N
from tramline.feed import from_rows
from tramline.operators import crop, repair
from tramline.plans import transform
from tramline.plans.validate import validate_feed


def broken():
    t = feeds.clean()
    t["stops.txt"] = [s | {"wheelchair_boarding": "9", "parent_station": ""} for s in t["stops.txt"]] + [{"stop_id": "s3", "stop_name": "Three"}]
    t["trips.txt"][0]["shape_id"] = "gone"
    t["trips.txt"] += [{"route_id": "none", "service_id": "wk", "trip_id": "u"}, {"route_id": "r", "service_id": "wk", "trip_id": "v"}]
    t["stop_times.txt"] += [{"trip_id": k, "arrival_time": "09:00:00", "departure_time": "09:00:00", "stop_id": s, "stop_sequence": q} for k, s, q in (("u", "s1", "1"), ("u", "s2", "2"), ("v", "s1", "1"), ("v", "s3", "2"))]
    return t


@pytest.mark.slow
def test_repair_is_complete_and_idempotent(spark, tmp_path):
    path = feeds.write(tmp_path / "in.zip", broken(), **{"notes.md": "kept", "../evil.txt": "no"})
    done = transform.repair_feed(spark, path, str(tmp_path / "out.zip"), reference_date="2026-06-01")
    assert {r.action for r in done.fixes.collect()} == {"default_value", "clear_reference", "drop_entity"}
    assert done.remaining.row_counts["trips.txt"] == 1
    assert done.remaining.row_counts["stop_times.txt"] == 2
    assert not done.remaining.errors()
    again = transform.repair_feed(spark, str(tmp_path / "out.zip"), str(tmp_path / "again.zip"), reference_date="2026-06-01")
    assert again.fixes.count() == 0
    names = zipfile.ZipFile(tmp_path / "out.zip").namelist()
    assert "notes.md" in names and "../evil.txt" not in names


@pytest.mark.slow
def test_repair_refuses_unsafe_and_sampled(spark, tmp_path):
    path = feeds.write(tmp_path / "in.zip", broken())
    with pytest.raises(OSError, match="incomplete"):
        transform.repair_feed(spark, path, str(tmp_path / "o.zip"), reference_date="2026-06-01", max_notices_per_file=1)
    with pytest.raises(OSError, match="cut short"):
        transform.repair_feed(spark, path, str(tmp_path / "o.zip"), max_rows=1)
    with pytest.raises(OSError, match="source itself"):
        transform.repair_feed(spark, path, path, reference_date="2026-06-01")


def test_parent_station_is_cleared_unless_strict(spark):
    t = feeds.clean()
    t["stops.txt"][0]["parent_station"] = "gone"
    feed = from_rows(spark, t)
    lost = spark.createDataFrame([("rules", "stops.txt", "foreign_key_violation", "ERROR", 2, 2, 0, {"childFilename": "stops.txt", "childFieldName": "parent_station", "csvRowNumber": "2"})], N.SCHEMA)
    kept = repair.repair(feed, lost).feed.tables["stops.txt"]
    assert {(r.stop_id, r.parent_station) for r in kept.collect()} == {("s1", ""), ("s2", "")}
    assert repair.repair(feed, lost, strict_compat=True).feed.tables["stops.txt"].count() == 1


def crop_feed():
    t = feeds.clean()
    t["stops.txt"].append({"stop_id": "s3", "stop_name": "Far", "stop_lat": "61.5", "stop_lon": "24.9"})
    t["routes.txt"].append({"route_id": "q", "agency_id": "a", "route_short_name": "2", "route_type": "3"})
    t["calendar.txt"].append(t["calendar.txt"][0] | {"service_id": "old", "start_date": "20250101", "end_date": "20250201"})
    t["trips.txt"] = [{"route_id": r, "service_id": s, "trip_id": k} for r, s, k in (("r", "wk", "in"), ("r", "old", "past"), ("q", "wk", "far"))]
    t["stop_times.txt"] = [{"trip_id": k, "arrival_time": "08:00:00", "departure_time": "08:00:00", "stop_id": s, "stop_sequence": q} for k, a, b in (("in", "s1", "s3"), ("past", "s1", "s2"), ("far", "s3", "s3")) for q, s in (("1", a), ("2", b))]
    return t


@pytest.mark.parametrize(("options", "trips"), [({"box": (24.8, 60.0, 25.1, 60.3)}, {"in", "past"}), ({"start": "20260601", "end": "20260630"}, {"in", "far"}), ({"box": (24.8, 60.0, 25.1, 60.3), "start": "20260601"}, {"in"}), ({"box": (24.8, 60.0, 25.1, 60.3), "full": True}, {"past"})])
def test_crop(spark, options, trips):
    cut = crop.crop(from_rows(spark, crop_feed()), **options)
    assert {r.trip_id for r in cut.tables["trips.txt"].collect()} == trips


def test_crop_archive_clamps(spark, tmp_path):
    path = feeds.write(tmp_path / "in.zip", crop_feed())
    done = transform.crop_feed(spark, path, str(tmp_path / "out.zip"), box=(24.8, 60.0, 25.1, 60.3), start_date="20260601", end_date="20260630")
    assert done.remaining.service_window == ("20260601", "20260630")
    assert done.remaining.row_counts["stops.txt"] == 2  # the stop outside is on a kept trip
    with pytest.raises(ValueError, match="nothing to crop"):
        transform.crop_feed(spark, path, str(tmp_path / "x.zip"))
    with pytest.raises(ValueError, match="invalid crop date"):
        crop.crop(from_rows(spark, crop_feed()), start="tomorrow")
    assert validate_feed(spark, str(tmp_path / "out.zip"), reference_date="2026-06-01").codes().get("foreign_key_violation") is None
