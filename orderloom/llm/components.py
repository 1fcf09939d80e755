"""Connected components of an edge table by alternating large-star and small-star steps.

A star step sends each neighbour of a node to the smallest node it knows; the two steps alternate until the edges stop
changing, which takes a number of rounds in the order of the logarithm of the longest chain. Each round is written to
the shared folder. Minima are taken before shuffling, and the joins are of a kind that adaptive execution can split, so
a hub with very many neighbours is no obstacle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a, b with a > b. Large: neighbours above a node go to its minimum; small: those below it, and itself."""
    if large:
        sides = _both_ways(edges)
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        moved = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        below = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = below.unionByName(least.select("a", F.col("least").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs, any direction, repeats allowed). Returns node, root: every node of an edge, with the smallest node of its component."""
    current = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        after = materialize(_star(_star(current, True), False), "edges")
        discard(current)
        current = after
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return nodes.unionByName(roots)
