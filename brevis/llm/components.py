"""Connected components of an edge table, by alternating large-star and
small-star steps (Kiveris et al., 2014).  Each step is an aggregation with
map-side combining and a join, which adaptive execution can split at a hot node;
its result is written to the shared folder, so lost executors cost one step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each row of ``pairs`` with the least of u and its neighbours v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the least node that
    is reachable.  Self-loops and repeated edges are allowed.  The result may be
    given to ``discard``."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        starred = _stars(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        before, now = now, cut(small, "edges")
        discard(before)
        n = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(n) == mark:
            break
        mark = tuple(n)
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    found.cut_folder = now.cut_folder
    return found
