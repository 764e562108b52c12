import math

import pytest
from pyspark.sql import functions as F

from tests import feeds
from tramline.feed import Feed, from_rows
from tramline.functions import geo, text, times
from tramline.operators import build, edit, network
from tramline.plans import transform

LINE = [(60.16, 24.90), (60.17, 24.93), (60.18, 24.96)]


def lines(spark, **attributes):
    row = {"route_id": "m1", "mode": "tram", "headway_min": "10"} | attributes
    frame = spark.createDataFrame([tuple(row.values())], list(row))
    return frame.withColumn("points", build.line_of(LINE))


@pytest.mark.slow
def test_editor_round_trip(spark, tmp_path):
    e = edit.Editor(spark).add_agency("a", "A", "https://example.com", "UTC").add_stop("s1", "One", 60.1, 24.9).add_stop("s2", "Two", 60.2, 25.0, zone_id="z")
    e.add_route("r", 3, "1", agency_id="a").add_service("wk", "weekdays", "20260101", "20261231").add_shape("sh", [(60.1, 24.9), (60.2, 25.0)])
    e.add_trip("r", "wk", "t", [("s1", "08:00:00", 28_800), ("s2", "8:10:00", "08:11:00")], shape_id="sh").add_frequency_trip("r", "wk", "f", [("s1", 0), ("s2", "0:10:00")], start="06:00:00", end="22:00:00", headway=600)
    result = transform.save(spark, e.feed, str(tmp_path / "out.zip"), reference_date="2026-06-01")
    assert not result.errors()
    assert result.row_counts["stop_times.txt"] == 4
    e.shift_trip("f", 3600).set_headway("f", 300, start="07:00:00").update_stop("s1", stop_desc="x")
    assert e.feed.tables["frequencies.txt"].first().asDict() == {"csv_row": 2, "trip_id": "f", "start_time": "07:00:00", "end_time": "23:00:00", "headway_secs": "300"}
    assert {r.stop_desc for r in e.feed.tables["stops.txt"].collect()} == {"x", ""}
    e.drop_route("r")
    assert e.feed.tables["stop_times.txt"].count() == 0
    for wrong in (lambda: e.update_stop("none", x=1), lambda: e.shift_trip("none", 1), lambda: edit.Editor(spark).add_service("s", "someday", "1", "2"), lambda: edit.Editor(spark).add_shape("s", [(1, 2)])):
        with pytest.raises(ValueError):
            wrong()


@pytest.mark.slow
def test_invalid_feed_is_not_saved(spark, tmp_path):
    t = feeds.clean()
    t["trips.txt"][0]["route_id"] = "gone"
    with pytest.raises(transform.InvalidFeedError):
        transform.save(spark, from_rows(spark, t), str(tmp_path / "x.zip"), reference_date="2026-06-01")
    assert not (tmp_path / "x.zip").exists()


def test_build_exact_times(spark):
    feed = build.build(lines(spark, bidirectional="no"), timezone="Europe/Helsinki", exact_times=True)
    assert feed.tables["trips.txt"].count() == 96
    assert feed.tables["trips.txt"].agg(F.countDistinct("csv_row")).first()[0] == 96


@pytest.mark.slow
def test_build_validates(spark, tmp_path):
    feed = build.build(lines(spark), timezone="Europe/Helsinki")
    result = transform.save(spark, feed, str(tmp_path / "b.zip"), reference_date="2026-06-01")
    assert not result.errors()
    assert feed.tables["trips.txt"].count() == 2 and feed.tables["frequencies.txt"].count() == 2


def test_build_with_stop_layer(spark):
    stops = spark.createDataFrame([("a", "A", 60.1601, 24.9002), ("b", "B", 60.1801, 24.9598), ("c", "C", 61.0, 24.9)], "stop_id string, stop_name string, stop_lat double, stop_lon double")
    feed = build.build(lines(spark, duration_min="10", bidirectional="0"), timezone="UTC", stops=stops)
    rows = feed.tables["stop_times.txt"].orderBy("csv_row").collect()
    assert [(r.stop_id, r.arrival_time) for r in rows] == [("a", "06:00:00"), ("b", "06:10:00")]


@pytest.mark.parametrize(("attributes", "message"), [({"mode": "rocket"}, "unknown mode"), ({"headway_min": " "}, "no headway"), ({"headway_min": "0"}, "positive"), ({"first_departure": "23:00:00"}, "end after"), ({"speed_kmh": "-1"}, "run time"), ({"monday": "0"}, "no day")])
def test_build_refuses(spark, attributes, message):
    with pytest.raises(ValueError, match=message):
        build.build(lines(spark, **attributes), timezone="UTC")


def net(spark):
    nodes = spark.createDataFrame([(k, 60.0 + 0.001 * (k // 3), 24.0 + 0.001 * (k % 3), {}) for k in range(9)], "id bigint, lat double, lon double, tags map<string,string>")
    ways = spark.createDataFrame([(100, [0, 1, 2], {"highway": "residential"}), (101, [2, 5, 8], {"highway": "residential"}), (102, [0, 3, 77, 6, 7, 8], {"railway": "rail"})], "id bigint, nodes array<bigint>, tags map<string,string>")
    return network.Network(nodes, ways)


def test_network_edits(spark):
    n = net(spark)
    assert {(r.way_id, r.run, len(r.line)) for r in n.runs().collect()} == {(100, 0, 3), (101, 0, 3), (102, 0, 2), (102, 1, 3)}
    grown, own = n.add_node(24.5, 60.5, name="x")
    assert own == -1 and grown.add_way([0, own])[1] == -2
    assert n.delete_way(100).nodes.count() == 8  # node 1 was only there
    assert n.delete_node(1).ways.where("id = 100").first().nodes == [0, 2]
    assert n.filtered({"railway": ["rail"]}).ways.count() == 1
    assert n.retag_way(100, highway="primary").ways.where("id = 100").first().tags == {"highway": "primary"}
    for wrong in (lambda: n.add_way([0]), lambda: n.move_node(99, 1, 2), lambda: n.retag_node(0, id="1")):
        with pytest.raises(ValueError):
            wrong()


def test_snap(spark):
    line = net(spark).filtered({"highway": True}).snap([(60.0, 24.0), (60.002, 24.002)])
    assert [(round(a, 3), round(b, 3)) for a, b in line] == [(60.0, 24.0), (60.0, 24.001), (60.0, 24.002), (60.001, 24.002), (60.002, 24.002)]


def test_expressions(spark):
    values = ["12", " 12", "+7", "1d", "NaN", "inf", "1e3", ".5", "", "9223372036854775808"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.as_int(F.col("v")).alias("i"), text.as_float(F.col("v")).alias("f")).collect()
    assert {r.v: r.i for r in got} == {"12": 12, " 12": None, "+7": 7, "1d": None, "NaN": None, "inf": None, "1e3": None, ".5": None, "": None, "9223372036854775808": None}
    f = {r.v: r.f for r in got}
    assert f["1e3"] == 1000 and f[".5"] == 0.5 and f["1d"] is None and f[" 12"] is None and math.isinf(f["inf"]) and math.isnan(f["NaN"])
    day = spark.createDataFrame([("20260230",), ("20240229",), ("2024-02-29",), ("25:00:00",), ("1:60:00",), ("1:2:03",)], "v string")
    assert [r.s for r in day.select(times.as_seconds(F.col("v")).alias("s")).collect()] == [None, None, None, 90_000, None, None]
    assert [str(r.d) for r in day.select(times.as_date(F.col("v")).alias("d")).collect()][:3] == ["None", "2024-02-29", "None"]
    assert abs(spark.range(1).select(geo.haversine_m(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])).first()[0] - 111_195.08) < 0.1
    assert spark.range(1).select(text.utrim(F.lit("  x\t\n"))).first()[0] == "x"
    assert edit.clock(edit.seconds("25:00:01")) == "25:00:01"
    assert isinstance(Feed({}).names("x"), tuple)
