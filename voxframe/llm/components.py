"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (large star) or smaller (small star) neighbours of each node on the least of them."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = both.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(
            F.col("e.v").alias("u"), F.col("e.m").alias("v")
        )
    return out.where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one other at most, and nothing hangs on one that hangs itself: then no round changes anything."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs")).union(edges.select("v", F.lit(0)))
    counted = ends.groupBy("node").agg(F.sum("hangs").alias("on"), F.min("hangs").alias("least"))
    return counted.where((F.col("on") > 1) | ((F.col("on") == 1) & (F.col("least") == 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two columns) that is not the least of its component.

    Both directions, repeated links and links of a node with itself are all right. Each round shuffles the links
    twice and is written to the shared folder, as the result is; the rounds needed grow with the logarithm of the longest
    chain, and links that are settled need none.
    """
    a, b = links.columns
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    while not _settled(edges):
        edges = stored(_star(_star(edges, large=True), large=False), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
