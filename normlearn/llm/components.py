"""Connected components of a graph by alternating large and small stars.

Every step is a grouped minimum, combined before its shuffle, and an equi-join,
so a vertex with very many edges costs no task more than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _stars(edges: DataFrame) -> bool:
    """Whether each vertex has one edge down, to a vertex that has none: then those are the components."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    each = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return each.filter("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: u, v (long).  Returns u and v, the smallest vertex reachable from u, for every u that is not it."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = scratch.written(edges, "edges")
    while not _stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, current = current, scratch.written(small, "edges")
        scratch.remove(before)
    return current
