"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and joins on node ids, written as a table in the shared folder.
Minima are aggregated before the shuffle and joined back, so a node with very many edges is
neither collected nor held by one task (a skewed join partition is split at run time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.runtime import materialize


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: (u, v) with u > v in, the same components with shorter paths out."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.filter("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of all nodes but the roots, from edges (u, v)."""
    now = materialize(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = materialize(stars(stars(now, True), False), "stars")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(found)
