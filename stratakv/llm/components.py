"""Connected components of an edge table by alternating star contraction, on the cluster alone.

Large-star links every larger neighbour of a node to the least of its neighbourhood, small-star links every
smaller neighbour (and the node) to the least of them; a forest of stars with the least node of each
component in the middle is the only fixed point.  Each round is two joins on equal keys, with hot nodes
left to skew joins, and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, tasks


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component) for every node of edges(a, b), both of one orderable type; component is the least node reachable.

    Self-loops, repeated edges and either direction are allowed; rows with a null end are ignored.  most: tasks that
    the first table is written with at most.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(edges, "edges", most)
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = now.select(F.col("v").alias("x"), F.col("u").alias("y")).join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        # an edge (y, x) with y > x is seen from x only: large-star emits for larger neighbours
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges", tasks(now.sparkSession, state[0], 200_000))
        found = _state(after)
        discard(now)
        now = after
        if found == state:
            break
        state = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
