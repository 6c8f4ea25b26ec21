"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.plans.staging import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Loops, repeated edges and edges with a null end change nothing. No edges: an empty table. The rounds grow with the
    logarithm of the number of nodes; each works on edges only and is written to the shared folder.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs, before = materialize(pairs), None
    while True:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written before they are joined: then the rows of a node with very many neighbours are split over tasks.
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        # Large star: larger neighbours of a node hang on its smallest neighbour.
        large = materialize(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct())
        # Small star: a node's smaller neighbours hang on the smallest of them, and so does the node.
        small = materialize(large.groupBy("b").agg(F.min("a").alias("m")))
        joined = large.join(small, "b")
        pairs = materialize(joined.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return found.union(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
