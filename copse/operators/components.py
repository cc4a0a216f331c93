"""Distributed connected components by alternating large-star and small-star steps.

The two steps only ever group by one node and join on it, so no component is held in one place. (Kiveris et al.,
"Connected Components in MapReduce and Beyond", 2014.) Each step's edges are dealt by node once, into as many parts as
the edges fill, and both its grouping and its join use that; beyond ``PLANNED`` parts this is left to the planner, whose
skew handling splits a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.session import cut

#: Edges of a part, and parts up to which they are dealt by number.
PART_EDGES, PLANNED = 250_000, 64


def _dealt(edges: DataFrame, parts: int) -> DataFrame:
    return edges.repartition(parts, "u") if parts <= PLANNED else edges


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = _dealt(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), parts)
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return _dealt(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), parts).distinct()


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _dealt(moved.unionByName(least.select("u", F.col("m").alias("v"))), parts).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge to another; root is the smallest node reachable.

    Edges may repeat, be in either direction, or join a node to itself; edges with a null end are ignored.
    No edges give an empty result.
    """
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before, parts = None, None
    while True:
        # the sums say whether a round changed any edge
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, parts = state, parts or -(-state[0] // PART_EDGES)
        now = cut(_small_star(_large_star(now.coalesce(-(-state[0] // PART_EDGES)), parts), parts))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
