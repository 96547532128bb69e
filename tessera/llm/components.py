"""Connected components of an edge table, all rows distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def _settled(edges: DataFrame) -> bool:
    """Every node above hangs on one root, and no root hangs on another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("root")))
    nodes = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("root").alias("root"))
    return nodes.where("above > 1 OR above = 1 AND root = 1").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest id reachable) for every node of edges (a, b).

    Alternates large-star and small-star rewiring, both grouped minima with map-side combining, until the edges are
    a forest of stars; edges always point to the smaller id, so a star's root is its least node. Each round at
    least halves the depth of long chains. A node of any degree is one aggregate row. Minima are tables of their own:
    the joins that bring them back to the edges have exchanges of their own on both sides, so that adaptive
    execution splits the edges of a node with very many.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(most_rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "cc-least")
        # large star: neighbours above a node hang on its least neighbour (or on itself)
        large = cut(both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")), "cc-large")
        # small star: neighbours below a node, and the node, hang on the least of them
        below = cut(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "cc-below")
        small = large.join(below, F.col("u") == F.col("k"))
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
