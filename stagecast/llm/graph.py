"""Connected components of large graphs as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecast.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); component is its smallest node.

    Every node keeps a parent and the parent's parent. A round offers each node, and its
    parent, the smallest grandparent among its neighbours, then jumps the pointers; the
    number of rounds grows with the logarithm of a component's size. Hubs occur only on the
    many side of joins with one row per node, which adaptive execution splits, and in
    aggregates that combine before the shuffle. Each round ends in a table in the shared
    folder. Loops, repeated edges and edges with a null end are ignored.
    """
    pair = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    links = materialise(pair.select(ends.alias("e")).select("e.*").distinct(), "links")
    parents = links.groupBy("u").agg(F.min("v").alias("f")).select("u", F.least("u", "f").alias("f"))
    state, seen = _jump(parents), None
    while True:
        mark = state.agg(F.bit_xor(F.xxhash64("u", "f", "g"))).first()[0]
        if mark == seen:
            return state.select(F.col("u").alias("node"), F.col("g").alias("component"))
        seen = mark
        offered = (
            links.join(state.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        )
        moved = state.join(offered, "u").select(
            F.explode(
                F.array(
                    F.struct("u", F.least("f", "g", "m").alias("f")),
                    F.struct(F.col("f").alias("u"), F.least("g", "m").alias("f")),
                )
            ).alias("e")
        )
        state = _jump(moved.select("e.*").groupBy("u").agg(F.min("f").alias("f")))


def _jump(parents: DataFrame) -> DataFrame:
    parents = materialise(parents, "parents")
    above = parents.select(F.col("u").alias("f"), F.col("f").alias("g"))
    return materialise(parents.join(above, "f").select("u", "f", "g"), "state")
