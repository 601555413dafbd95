"""Connected components by alternating large and small stars, with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_written, written


#: Edges in a partition; small graphs stay in few partitions whatever the session's shuffle width.
EDGES_PER_PARTITION, LEAST_PARTITIONS = 200_000, 8


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Joins each node's larger neighbours to the smallest of the node and its neighbours; a partial aggregate meets hubs before the shuffle."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts)
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Joins each node and its smaller neighbours to the smallest of these. u > v in all edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts)


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Written edges, with their number and the sum of their hashes, which the job that writes them tells."""
    seen = Observation()
    now = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    return now, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs to (node, root): root is the smallest node that the node reaches.

    Nodes without an edge to another node don't appear; loops and repeated edges are ignored.
    A hub is never gathered: its rows meet in aggregates and in joins that Spark may split.
    """
    spark = edges.sparkSession
    now, state = _settled(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while state[0]:
        parts = max(LEAST_PARTITIONS, state[0] // EDGES_PER_PARTITION)
        new, after = _settled(_small_star(_large_star(now, parts), parts))
        drop_written(spark, now)
        now, before, state = new, state, after
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
