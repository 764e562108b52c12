"""A feed seen in the driver's star-schema tables.

Each feed table is one SELECT over a driver table, written once for both
Spark and the oracle; only a few functions differ between the dialects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..feed import Feed

#: Identity of a lineitem: order, line, part and supplier, in that order.
LINE_ROW = "(((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey)"
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def clock(self, seconds: str) -> str:
        parts = f"cast(floor(({seconds}) / 3600) as bigint), cast(floor((({seconds}) % 3600) / 60) as bigint), cast(({seconds}) % 60 as bigint)"
        return f"format_string('%02d:%02d:%02d', {parts})" if self.spark else f"format('{{:02d}}:{{:02d}}:{{:02d}}', {parts})"

    def ymd(self, date: str) -> str:
        return f"date_format({date}, 'yyyyMMdd')" if self.spark else f"strftime({date}, '%Y%m%d')"

    def weekday(self, date: str) -> str:
        return f"weekday({date})" if self.spark else f"(isodow({date}) - 1)"

    def decimal(self, hundredths: str) -> str:
        """Text with two decimals of a whole number of hundredths."""
        return f"concat(cast(cast(floor(({hundredths}) / 100) as bigint) as string), '.', lpad(cast(({hundredths}) % 100 as string), 2, '0'))"


def tables(d: Dialect) -> dict[str, str]:
    """SELECT of each feed table; csv_row first, all else text."""
    arrive = "(l_linenumber * 3600 + l_partkey % 5400)"
    leave = f"({arrive} + l_suppkey % 900 - 20 + 3600)"
    day = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    flags = ", ".join(f"case when sum(case when {d.weekday('o_orderdate')} = {k} then 1 else 0 end) % 3 <> 0 then '1' else '0' end as {n}" for k, n in enumerate(day))
    second = "(extract(hour from ts) * 3600 + extract(minute from ts) * 60)"
    return {
        "agency.txt": "select cast(r_regionkey + 2 as bigint) as csv_row, cast(r_regionkey as string) as agency_id, r_name as agency_name, '' as agency_url, case when r_regionkey = 3 then 'Europe/Nowhere' when r_regionkey = 4 then 'UTC' else 'Europe/Berlin' end as agency_timezone from region",
        "routes.txt": "select cast(n_nationkey + 2 as bigint) as csv_row, cast(n_nationkey as string) as route_id, cast(n_regionkey as string) as agency_id, case when n_nationkey % 4 = 0 then ' ' else n_name end as route_short_name, case when n_nationkey % 8 = 0 then 'Line' else '' end as route_long_name, cast(n_nationkey as string) as route_type from nation",
        "trips.txt": "select cast(o_orderkey + 2 as bigint) as csv_row, cast(o_custkey % 30 as string) as route_id, o_orderpriority as service_id, cast(o_orderkey as string) as trip_id, cast(o_custkey as string) as block_id, cast(o_custkey % 200 as string) as shape_id, cast(o_orderkey % 5 as string) as wheelchair_accessible from orders",
        "stop_times.txt": f"select cast({LINE_ROW} as bigint) as csv_row, cast(l_orderkey as string) as trip_id, case when l_returnflag = 'R' and l_suppkey % 10 = 0 then '' else {d.clock(arrive)} end as arrival_time, case when l_returnflag = 'A' and l_suppkey % 10 = 1 then '' else {d.clock(leave)} end as departure_time, cast(l_suppkey as string) as stop_id, cast(l_linenumber as string) as stop_sequence, cast(l_extendedprice as string) as shape_dist_traveled, case when l_linestatus = 'O' then '1' else '0' end as timepoint from lineitem",
        "stops.txt": f"select cast(s_suppkey + 2 as bigint) as csv_row, cast(s_suppkey as string) as stop_id, s_name as stop_name, case when s_suppkey % 11 = 0 then '' else {d.decimal('s_suppkey * 37 % 9500')} end as stop_lat, {d.decimal('s_suppkey * 91 % 18500')} as stop_lon, cast(s_suppkey % 6 as string) as location_type, case when s_suppkey % 3 = 0 then '' else cast(s_suppkey * 7 % 120 as string) end as parent_station from supplier where s_suppkey % 7 <> 3",
        "calendar.txt": f"select cast(row_number() over (order by o_orderpriority) + 1 as bigint) as csv_row, o_orderpriority as service_id, {flags}, {d.ymd('min(o_orderdate)')} as start_date, {d.ymd('max(o_orderdate)')} as end_date from orders where o_orderpriority <> '5-LOW' group by o_orderpriority",
        "calendar_dates.txt": f"select cast(o_orderkey + 2 as bigint) as csv_row, o_orderpriority as service_id, {d.ymd('o_orderdate')} as date, cast(o_orderkey % 10 + 1 as string) as exception_type from orders where o_orderkey % 10 < 2 and o_orderpriority < '5'",
        "frequencies.txt": f"select cast(event_id + 2 as bigint) as csv_row, cast(user_id as string) as trip_id, {d.clock(second)} as start_time, {d.clock(f'{second} + cast(floor(value) as bigint) * 60')} as end_time, cast(cast(floor(value) as bigint) as string) as headway_secs from events where event_type in ('click', 'signup')",
        "shapes.txt": f"select cast(event_id + 2 as bigint) as csv_row, cast(user_id as string) as shape_id, {d.decimal('event_id * 13 % 9500')} as shape_pt_lat, {d.decimal('event_id * 29 % 18500')} as shape_pt_lon, cast(event_id as string) as shape_pt_sequence, cast(cast(floor(value) as bigint) as string) as shape_dist_traveled from events where user_id % 10 <> 0",
        "transfers.txt": "select cast(c_custkey + 2 as bigint) as csv_row, cast(c_custkey % 130 as string) as from_stop_id, cast(c_nationkey as string) as to_stop_id, cast(c_custkey % 4 as string) as transfer_type, case when c_custkey % 5 = 0 then '' else '60' end as min_transfer_time from customer",
    }


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def selected(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SELECT over driver tables, each named once after FROM or JOIN."""
    words = sql.replace("(", " ( ").replace(")", " ) ").split()
    used = {b for a, b in zip(words, words[1:], strict=False) if a.lower() in ("from", "join") and b in SOURCES}
    for name in used:
        sql = sql.replace(f"from {name}", f"from {{{name}}}").replace(f"join {name}", f"join {{{name}}}")
    return spark.sql(sql, **{n: source(spark, sf_dir, n) for n in used})


def star_feed(spark: SparkSession, sf_dir: str, *names: str) -> Feed:
    """The feed tables, or those named."""
    sql = tables(Dialect(spark=True))
    return Feed({n: selected(spark, sf_dir, sql[n]) for n in (names or sql)})


def prelude(*names: str) -> str:
    """The same tables as CTEs of the oracle's dialect, named without their ending."""
    sql = tables(Dialect(spark=False))
    return "WITH " + ",\n".join(f"{n.removesuffix('.txt')} AS ({sql[n]})" for n in names)
