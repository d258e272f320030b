"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_tables, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) for each node of edges (u, v: long).

    Each round hangs every node's larger neighbours on its smallest one, then its smaller neighbours; rounds
    end when nothing changes, after about the logarithm of the longest path. Sums over a node's edges are
    partial aggregates, so a node with very many edges is no large group. Self loops, repeated and reversed
    edges don't matter; nulls have no component; no edges give an empty result."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        told = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(told) == seen or not told[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        seen = tuple(told)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first: a join right above the aggregate would share its exchange, and Spark could not split a hub's edges.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edges-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges-large")
        drop_tables(least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "edges-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        after = materialize(small, "edges")
        drop_tables(now, large, least)
        now = after
