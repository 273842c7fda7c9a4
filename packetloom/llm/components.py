"""Connected components of an edge table, by contraction.

In each round every node points to the least of itself and its neighbours, in an order that a hash of the
node gives, and the edges are drawn anew between the nodes pointed to. Nodes that no one points to are gone,
so a few rounds, about the logarithm of the longest chain, leave no edge. Then the rounds' maps are composed
backwards. Nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup_join


def components(edges: DataFrame) -> DataFrame:
    """edges: two bigint columns a, b, any direction, repeats and loops allowed, no nulls.
    Returns node, component (the smallest node of its component), size: one row for each node in an edge between two nodes."""
    spark = edges.sparkSession
    pairs = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps = []
    while (n := pairs.count()) > 0:
        seed = F.lit(len(maps) // 4)  # now and then another order, so that no chain is unlucky for long
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("n"))
        low = both.groupBy("a").agg(F.min(key("b")).alias("b"), F.count(F.lit(1)).alias("w"))
        to = cut(low.select(F.col("a").alias("node"), F.least(F.col("b"), key("a"))["n"].alias("to"), "w"))
        maps.append(to)
        moved = pairs.withColumnRenamed("a", "node")
        moved = lookup_join(moved, to, "node", "w", 2 * n).select(F.col("to").alias("a"), F.col("b").alias("node"))
        moved = lookup_join(moved, to, "node", "w", 2 * n).select("a", F.col("to").alias("b"))
        pairs = cut(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not maps:
        return spark.createDataFrame([], "node long, component long, size long")
    found = maps[-1].select("node", F.col("to").alias("root"))
    for to in reversed(maps[:-1]):
        step = to.select("node", "to")
        found = cut(
            step.join(found.select(F.col("node").alias("to"), F.col("root").alias("further")), "to", "left").select(
                "node", F.coalesce("further", "to").alias("root")
            )
        )
    found = cut(found)
    roots = cut(found.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size")))
    return lookup_join(found, roots, "root", "size", found.count()).select("node", "component", "size")
