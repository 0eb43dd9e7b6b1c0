"""Connected components of a link table by alternating large-star and small-star steps.

Nothing reaches the driver but counts. A star's centre is a hot key; its rows stay where they are (``skew.meet``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliate.runtime import discard, materialise

from .skew import meet


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    return meet(both.filter("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    near = meet(down, least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """links u, v -> node, component (smallest node reachable), for nodes that have a link."""
    edges = materialise(links.select("u", "v").filter("u <> v").distinct())
    seen = None
    while True:
        large = materialise(large_star(edges).distinct())
        new = materialise(small_star(large).filter("u <> v").distinct())
        discard(edges)
        discard(large)
        edges = new
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    # a star per component: every node points at the smallest
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
