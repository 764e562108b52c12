"""Registered queries over small tables whose every row counts."""

import math
from itertools import combinations

import pytest

from tramline.plans.queries import QUERIES


@pytest.fixture
def table(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_pair_numbers_of_every_block(spark, table):
    trips = {1: 1, 2: 2, 3: 5, 4: 6, 5: 150}
    orders = [(1000 * block + k, block, "1-URGENT") for block, n in trips.items() for k in range(n)]
    table("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string")
    lines = [(order, line, order % 97, 5, "N", "O", 10.0 * line) for order, _, _ in orders for line in (1, 2)]
    folder = table("lineitem", lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_linestatus string, l_extendedprice double")
    got = {tuple(r) for r in QUERIES["w14_block_pair_numbers"](spark, folder).collect()}
    assert got == {(str(block), i, j, k) for block, n in trips.items() for k, (i, j) in enumerate(combinations(range(n), 2), 1)}


def test_every_user_is_measured(spark, table):
    rows = [(k, k % 45) for k in range(1, 200)]
    folder = table("events", rows, "event_id bigint, user_id bigint")
    expected, last, along = {}, {}, {}
    for k, user in rows:
        lat, lon = math.radians(k * 13 % 9500 / 100), math.radians(k * 29 % 18500 / 100)
        a, b = last.get(user, (lat, lon))
        h = math.sin((lat - a) / 2) ** 2 + math.cos(a) * math.cos(lat) * math.sin((lon - b) / 2) ** 2
        along[user] = along.get(user, 0.0) + 2 * 6_371_008.8 * math.asin(math.sqrt(h))
        last[user], expected[(user, k)] = (lat, lon), along[user]
    got = {(r.user_id, r.event_id): r.along_m for r in QUERIES["w19_cumulative_distance"](spark, folder).collect()}
    assert got == pytest.approx(expected, abs=0.011)


def test_orphans_are_used_by_no_other_order(spark, table):
    lines = [(100, 1), (100, 2), (100, 3), (200, 3), (200, 4), (150, 2), (7, 1), (7, 9)]
    folder = table("lineitem", lines, "l_orderkey bigint, l_partkey bigint")
    assert sorted(r.node for r in QUERIES["u6_orphan_nodes"](spark, folder).collect()) == [3, 4]


def test_escapes_see_the_whole_text(spark, table):
    long = "Word <b> & " * 100 + "End!"
    folder = table("documents", [(1, long), (2, "Ab 'c'"), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: (r.clipped, r.html, r.slug) for r in QUERIES["x_text_escapes"](spark, folder).collect()}
    clipped = long[:120] + "…"
    html = clipped.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    assert got == {1: (clipped, html, "word-b-" * 100 + "end"), 2: ("Ab 'c'", "Ab &#x27;c&#x27;", "ab-c"), 3: (None, None, None)}


def test_shift_leaves_other_trips_alone(spark, table):
    lines = [(order, 1, 5, supplier, "R", "O", 1.0) for order in (100, 101) for supplier in (10, 21)]
    folder = table("lineitem", lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_linestatus string, l_extendedprice double")
    got = [tuple(r) for r in QUERIES["t13_shifted_trip"](spark, folder).orderBy("csv_row").select("arrival_time", "departure_time").collect()]
    assert got == [("", "25:59:54"), ("25:00:04", "26:00:05"), ("", "01:59:55"), ("01:00:05", "02:00:06")]
