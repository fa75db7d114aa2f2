"""Connected components of a graph given as a table of edges, by alternating star contractions.

Each round is two aggregations by vertex (Kiveris et al., "Connected Components in MapReduce and Beyond"): the large
star links every larger neighbour of a vertex to its smallest one, the small star every smaller neighbour. Rounds grow
with the logarithm of a component's size, the edges never grow in number, and no component is gathered in one task:
the smallest neighbour is a map-side minimum, joined back to the edges, so Spark can split a vertex with many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` (its smallest vertex) of every vertex of ``edges`` (``a, b``, longs, either direction)."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    state = None
    while True:
        # large star: larger neighbours go to the smallest neighbour
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = materialize(large, "star")
        # small star: the vertex and its smaller neighbours go to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
                 .filter("u <> v").distinct())
        now = materialize(small, "star")
        # a forest of stars: no vertex is both a centre and a member
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    stars = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("vertex"), "component")).distinct()
