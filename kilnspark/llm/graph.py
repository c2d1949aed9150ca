"""Connected components as DataFrames: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import Scratch


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (columns a and b, any one orderable type); component: the least node.

    Edges with a null end, loops and repeats count for nothing. Each round hangs every node on the least
    neighbour known; a hub's many edges meet its minimum by a join that adaptive execution can split, and are never
    gathered into one row. Rounds grow with the logarithm of a component's diameter. Each round is a written table; the one
    before it is dropped."""
    before = Scratch(edges.sparkSession)
    cur = before.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = _signature(cur)
    while mark[0]:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        root = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(root, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        after = Scratch(edges.sparkSession)
        cur = after.table(hung.unionByName(root.select(F.col("m").alias("a"), "b")).distinct(), "stars")
        before.drop()
        before = after
        now = _signature(cur)
        if now == mark:
            break
        mark = now
    members = cur.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.unionByName(cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
