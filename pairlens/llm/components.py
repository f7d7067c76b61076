"""Connected components of an edge table, by alternating star contraction.

Nodes are longs; the component id is the smallest node reachable. Each round
links every node's larger neighbours, then its smaller ones, to the smallest
neighbour (two grouped minima and two joins); the edge count never grows and a
hub's rows are only ever aggregated (partial minima) or joined, never gathered
into one row. Each round is written to the shared folder, so a lost executor
repeats one round at most. Rounds stop when the edges are the same as before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.filter("v > u").join(least, "u").filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` has u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``node, component`` for every node that has an edge to another node
    and isn't its component's smallest."""
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(now, "edges")
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state[0] == 0 or state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        now = stored(_small_star(_large_star(now)), "edges")
