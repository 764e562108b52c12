"""Road and rail networks: nodes(id, lat, lon, tags) and ways(id, nodes, tags).

Edits return new DataFrames.  Snapping finds each waypoint's nearest node by
an equi-join on grid cells and searches paths by rounds of relaxation over the
segments, so neither nodes nor segments are collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions import geo

# Tags that an edit may not set, and the default filter of a network.
RESERVED = ("id", "nodes", "lat", "lon", "geometry", "timestamp", "version", "changeset", "visible")
DEFAULT_FILTER: Mapping[str, Sequence[str] | bool] = {"highway": True, "railway": True}
CELL_DEG = 0.01


def matches(tags: Column, wanted: Mapping[str, Sequence[str] | bool]) -> Column:
    """True where any wanted tag is there, with one of the wanted values if they are listed."""
    out = F.lit(False)
    for key, values in wanted.items():
        value = F.element_at(tags, key)
        out = out | (value.isNotNull() if values is True else F.coalesce(value.isin(*values), F.lit(False)))
    return out


def _tags(tags: Mapping[str, str]) -> Column:
    if odd := sorted(set(tags) & set(RESERVED)):
        raise ValueError(f"reserved tags {odd}")
    pairs = [F.lit(str(x)) for kv in tags.items() for x in kv]
    return F.create_map(*pairs).cast("map<string,string>") if pairs else F.expr("cast(map() as map<string,string>)")


@dataclass(frozen=True)
class Network:
    nodes: DataFrame
    ways: DataFrame

    def filtered(self, wanted: Mapping[str, Sequence[str] | bool] = DEFAULT_FILTER, *, keep: bool = True) -> Network:
        """Ways kept (or excluded) by tag; each way once; nodes that they use."""
        hit = matches(F.col("tags"), wanted)
        ways = self.ways.where(hit if keep else ~hit).dropDuplicates(["id"])
        used = ways.select(F.explode("nodes").alias("id")).distinct()
        return Network(self.nodes.dropDuplicates(["id"]).join(used, "id", "left_semi"), ways)

    def least_id(self) -> int:
        """The smallest id among nodes, ways and members, or 0; provisional ids go below it."""
        ids = self.nodes.select("id").unionAll(self.ways.select("id")).unionAll(self.ways.select(F.explode("nodes").alias("id")))
        return min(0, ids.agg(F.min("id")).first()[0] or 0)

    # nodes
    def _need(self, rows: DataFrame, what: str, ids: Sequence[int]) -> None:
        known = {r.id for r in rows.where(F.col("id").isin(*ids)).select("id").collect()}
        if missing := [i for i in ids if i not in known]:
            raise ValueError(f"unknown {what} ids {missing}")

    def add_node(self, lon: float, lat: float, **tags: str) -> tuple[Network, int]:
        own = self.least_id() - 1
        row = self.nodes.sparkSession.range(1).select(F.lit(own).cast("bigint").alias("id"), F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"), _tags(tags).alias("tags"))
        return replace(self, nodes=self.nodes.unionByName(row)), own

    def move_node(self, node_id: int, lon: float, lat: float) -> Network:
        self._need(self.nodes, "node", [node_id])
        hit = F.col("id") == node_id
        return replace(self, nodes=self.nodes.withColumns({"lat": F.when(hit, F.lit(float(lat))).otherwise(F.col("lat")), "lon": F.when(hit, F.lit(float(lon))).otherwise(F.col("lon"))}))

    def retag_node(self, node_id: int, **tags: str) -> Network:
        self._need(self.nodes, "node", [node_id])
        return replace(self, nodes=retagged(self.nodes, node_id, tags))

    def delete_node(self, node_id: int) -> Network:
        """The node goes, also from its ways; a provisional way left with one member goes too."""
        self._need(self.nodes, "node", [node_id])
        ways = self.ways.withColumn("nodes", F.array_remove("nodes", F.lit(node_id).cast("bigint")))
        return Network(self.nodes.where(F.col("id") != node_id), ways.where((F.col("id") >= 0) | (F.size("nodes") >= 2)))

    # ways
    def _members(self, node_ids: Sequence[int]) -> Column:
        if len(node_ids) < 2:
            raise ValueError("a way needs at least two nodes")
        self._need(self.nodes, "node", list(dict.fromkeys(node_ids)))
        return F.array(*[F.lit(i).cast("bigint") for i in node_ids])

    def add_way(self, node_ids: Sequence[int], **tags: str) -> tuple[Network, int]:
        own = self.least_id() - 1
        row = self.ways.sparkSession.range(1).select(F.lit(own).cast("bigint").alias("id"), self._members(node_ids).alias("nodes"), _tags(tags).alias("tags"))
        return replace(self, ways=self.ways.unionByName(row)), own

    def reshape_way(self, way_id: int, node_ids: Sequence[int]) -> Network:
        self._need(self.ways, "way", [way_id])
        return replace(self, ways=self.ways.withColumn("nodes", F.when(F.col("id") == way_id, self._members(node_ids)).otherwise(F.col("nodes"))))

    def retag_way(self, way_id: int, **tags: str) -> Network:
        self._need(self.ways, "way", [way_id])
        return replace(self, ways=retagged(self.ways, way_id, tags))

    def delete_way(self, way_id: int) -> Network:
        """The way goes, and those of its nodes that no other way has."""
        self._need(self.ways, "way", [way_id])
        return self.delete_ways(F.col("id") == way_id)

    def delete_ways(self, which: Column) -> Network:
        """The ways that ``which`` is true of go, and the nodes that no way left has."""
        return Network(self.nodes.join(self.orphans(which), "id", "left_anti"), self.ways.where(~F.coalesce(which, F.lit(False))))

    def orphans(self, which: Column) -> DataFrame:
        """(id): nodes that only such ways have."""
        hit = F.coalesce(which, F.lit(False))
        members = self.ways.select(F.explode("nodes").alias("node"), hit.alias("goes"))
        return members.groupBy(F.col("node").alias("id")).agg(F.min("goes").alias("goes")).where("goes").select("id")

    # views
    def runs(self) -> DataFrame:
        """(way_id, run, line): each way's members in order, split where a node is missing."""
        members = self.ways.select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("pos", "id")).join(self.nodes.select("id", "lat", "lon"), "id")
        return runs_of(members, "way_id", "pos").groupBy("way_id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("line")).where(F.size("line") >= 2).withColumn("line", F.transform("line", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))))

    def segments(self) -> DataFrame:
        """(a, b, length_m): neighbouring nodes of ways, both directions, parallel ones by the shortest."""
        members = self.ways.select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("pos", "a"))
        pairs = members.withColumn("b", F.lead("a").over(Window.partitionBy("way_id").orderBy("pos"))).where("b is not null and a <> b")
        at = {s: self.nodes.select(F.col("id").alias(s), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}")) for s in "ab"}
        met = pairs.join(at["a"], "a").join(at["b"], "b").withColumn("length_m", geo.haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))
        both = met.select("a", "b", "length_m").unionAll(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "length_m"))
        return both.groupBy("a", "b").agg(F.min("length_m").alias("length_m"))

    def snap(self, waypoints: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
        """The line along the network through the nodes nearest to (lat, lon) waypoints."""
        if len(waypoints) < 2:
            raise ValueError("snapping needs at least two waypoints")
        spark = self.nodes.sparkSession
        points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(waypoints)], "k int, lat double, lon double")
        near = {r.k: r.id for r in nearest(points, "k", self.nodes).collect()}
        if len(near) < len(waypoints):
            raise ValueError("no node near a waypoint")
        segments = tables.written(self.segments(), "segments")
        stops = [near[k] for k in range(len(waypoints))]
        path: list[int] = stops[:1]
        for a, b in zip(stops, stops[1:], strict=False):
            leg = shortest_path(segments, a, b)
            if leg is None:
                raise ValueError(f"no path from node {a} to node {b}")
            path += [n for n in leg if n != path[-1]] if len(leg) > 1 else []
        tables.discard(segments)
        at = {r.id: (r.lat, r.lon) for r in self.nodes.where(F.col("id").isin(*set(path))).collect()}
        return [at[n] for n in path]


def retagged(rows: DataFrame, own: int, tags: Mapping[str, str]) -> DataFrame:
    """Tags set on one row; the others keep theirs."""
    new = F.map_concat(F.map_filter("tags", lambda k, _: ~k.isin(*tags) if tags else F.lit(True)), _tags(tags))
    return rows.withColumn("tags", F.when(F.col("id") == own, new).otherwise(F.col("tags")))


def runs_of(rows: DataFrame, group: str, position: str) -> DataFrame:
    """Gaps and islands: ``run`` numbers stretches of consecutive positions from 0."""
    order = Window.partitionBy(group).orderBy(position)
    gap = F.coalesce((F.col(position) - F.lag(position).over(order) > 1).cast("int"), F.lit(0))
    return rows.withColumn("gap", gap).withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("gap")


def nearest(points: DataFrame, key: str, nodes: DataFrame, *, rings: int = 8) -> DataFrame:
    """(key, id, distance_m): the nearest node of each point(key, lat, lon); ties to the smaller id.

    Points look in their grid cell and those around it; what finds a node only
    beyond the certain radius, or none, looks again in cells four times as wide.
    The last ring's cells span the globe.  Each ring's finds are written, so
    the plan doesn't grow, and the search ends with the last point found.
    """
    found: DataFrame | None = None
    rest, size = points, CELL_DEG
    for ring in range(rings):
        steps = F.sequence(F.lit(-1), F.lit(1))
        near = rest.withColumns({"py": F.floor(F.col("lat") / size), "px": F.floor(F.col("lon") / size)}).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
        near = near.select(key, F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), (F.col("py") + F.col("dy")).alias("cy"), (F.col("px") + F.col("dx")).alias("cx"))
        placed = nodes.select("id", "lat", "lon", F.floor(F.col("lat") / size).alias("cy"), F.floor(F.col("lon") / size).alias("cx"))
        d = geo.haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
        best = near.join(placed, ["cy", "cx"]).withColumn("d", d).groupBy(key).agg(F.min(F.struct("d", "id")).alias("best"), F.max(F.cos(F.radians("lat0"))).alias("shrink"))
        # Any node nearer than one cell's side stands in the cells looked at.
        certain = F.lit(ring == rings - 1) | (F.col("best.d") <= F.lit(size * 111_000.0) * F.least(F.lit(1.0), F.col("shrink")))
        sure = tables.written(best.where(certain).select(key, F.col("best.id").alias("id"), F.col("best.d").alias("distance_m")), "nearest")
        found = sure if found is None else found.unionAll(sure)
        rest = rest.join(sure.select(key), key, "left_anti")
        if not rest.limit(1).count():
            break
        size *= 4
    return found


def shortest_path(segments: DataFrame, start: int, end: int, *, most: int = 10_000) -> list[int] | None:
    """Node ids from start to end, by rounds of relaxation; None if there is no path.

    Each round extends only the nodes that the last one improved, and drops
    those already farther than the end.  Improved nodes carry their path; both
    tables of a round are written and those of the round before deleted.
    """
    if start == end:
        return [start]
    spark = segments.sparkSession
    front = spark.createDataFrame([(start, 0.0, [start])], "id bigint, d double, path array<bigint>")
    best = tables.written(front.select("id", "d"), "best")
    old_front: DataFrame | None = None
    goal = None
    for _ in range(most):
        ahead = front if goal is None else front.where(F.col("d") < goal.d)
        step = ahead.join(segments, ahead["id"] == segments["a"]).select(F.col("b").alias("id"), (F.col("d") + F.col("length_m")).alias("d"), F.concat("path", F.array("b")).alias("path"))
        step = step.groupBy("id").agg(F.min(F.struct("d", "path")).alias("s")).select("id", "s.d", "s.path")
        known = best.select("id", F.col("d").alias("old"))
        front = tables.written(step.join(known, "id", "left").where("old is null or d < old").select("id", "d", "path"), "front")
        if old_front is not None:
            tables.discard(old_front)
        old_front = front
        if not front.limit(1).count():
            return goal.path if goal is not None else None
        goal = front.where(F.col("id") == end).first() or goal
        wider = tables.written(best.join(front.select("id"), "id", "left_anti").unionAll(front.select("id", "d")), "best")
        tables.discard(best)
        best = wider
    raise RuntimeError(f"no shortest path from {start} to {end} settled in {most} rounds")
