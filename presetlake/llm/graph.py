"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presetlake.llm.common import discard, store


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` longs to ``(node, root)``: each node that has an edge and the smallest node of its component.

    Alternates large-star and small-star steps until the edges are stars. A step sends a node's minimum to its
    neighbours by a partially aggregated groupBy and an equi-join, so a node with many edges is no group in one task;
    every round is stored in the shared folder. Null ends and loops are no edges; no edges give no rows.
    """
    edges = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, last = store(small.union(own).distinct()), edges
        discard(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
