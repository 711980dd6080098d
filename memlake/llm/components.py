"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and two joins of the edges, which shrink to one
edge a node; rounds grow with the logarithm of the longest path.  Each step is
a written table, so lost executors cost one step at most, and only a count and
a checksum of the edges reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.session import materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, comp`` for every node of the undirected edges; ``comp`` is the smallest node reached."""
    at = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi != lo").distinct()
    at = materialize(at, "edges")
    before = _mark(at)
    while before[0]:
        both = at.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            at.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # minima are written before their join, so that Spark can split the edges of a large star over tasks
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = materialize(both.where("v > u").join(low, "u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "stars")
        least = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "stars")
        joined = large.join(least, "hi")
        small = joined.select("hi", F.col("m").alias("lo")).unionByName(
            joined.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()
        at = materialize(small, "edges")
        after = _mark(at)
        if after == before:
            break
        before = after
    nodes = at.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
    return nodes.unionByName(at.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())
