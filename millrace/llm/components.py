"""Connected components of an edge table, as DataFrames all through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the least node of the component.

    Alternating large-star and small-star steps: each step moves edges towards the least
    neighbour, and the table becomes a set of stars in a logarithmic number of rounds. The
    minimum of a neighbourhood is a partial aggregate; the joins that hand it back meet all edges of a hub under one
    key, against one row, and leave it to adaptive execution to split such a key. Each round is written to the shared folder, and
    deleted when the next one is. Self-loops and repeated edges are ignored; no edges give an empty table. Raises if ``rounds`` doesn't suffice.
    """
    current = common.stage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc"
    )
    if current.isEmpty():
        return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for k in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        nxt = common.stage(small, f"cc{k}")
        # Stars: every node has one parent, and no parent has a parent.
        common.release(current)
        state = nxt.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        if state["n"] == state["d"] and nxt.select("v").distinct().join(nxt.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("root"))
        current = nxt
    raise RuntimeError(f"components: not settled after {rounds} rounds")
