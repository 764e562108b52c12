"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and two equi-joins, so a hub node is
pre-aggregated before its shuffle and a hot join key can be split; no
component is ever gathered in one task.  Each round's edges are written to the
shared folder.  The rows never outnumber the edges given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _print_of(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges, to tell when a round changed nothing."""
    sums = [F.sum(F.shiftrightunsigned(F.xxhash64("a", "b"), s).bitwiseAND(F.lit((1 << 31) - 1))) for s in (0, 31)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())


def connected(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): each node that has an edge, and the smallest node it reaches.

    Self-loops, repeated edges and edges with a null end count for nothing.
    The nodes may be of any type that Spark can order.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    e = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").select(b.alias("a"), a.alias("b")).distinct()
    e = shared.written(e, "edges")
    last = _print_of(e)
    while last[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = shared.written(large.where("a <> b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").unionAll(low.select(F.col("a").alias("x"), "m"))
        before = e
        e = shared.written(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "small-star")
        shared.discard(before)
        shared.discard(large)
        now = _print_of(e)
        if now == last:
            break
        last = now
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
