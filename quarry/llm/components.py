"""Connected components by alternating large and small stars, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stash


def components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected edges between longs -> (node, root), root the smallest node reachable, for every node of an edge.

    Each round writes its edges to the shared folder. The rounds grow with the logarithm of a component's diameter. Loops
    and repeated edges do no harm; edges with a null are left out. No edges give an empty table. Minima are combined
    before the shuffle, and the joins read written tables, so that a node with very many neighbours can be split.
    """
    e = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        # large star: neighbours above a node move to the smallest of its neighbourhood
        large = stash(both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = stash(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        # small star: a node's lower neighbours move to the smallest of them
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stash(small.union(least.select("a", "m")).distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        seen = now
