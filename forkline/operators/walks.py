"""Walks over a diagram: the spine from each entry, and runs of decisions without choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forkline.operators.graph import bfs_levels, reach_sizes


def spine(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Edges that a walk from the entries (node) takes, always to the successor that reaches most: src, dst, arm.

    Edges are (src, dst, arm); of equal successors the least (arm, dst) is taken; walks end where they meet their own path.
    """
    reach = reach_sizes(edges).select(F.col("node").alias("dst"), "reach")
    ranked = edges.select("src", "dst", "arm").join(reach, "dst", "left").select("src", F.struct((-F.coalesce("reach", F.lit(0))).alias("less"), "arm", "dst").alias("way"))
    taken = ranked.groupBy("src").agg(F.min("way").alias("way")).select("src", "way.dst", "way.arm")
    return taken.join(bfs_levels(taken, entries).select(F.col("node").alias("src")), "src", "left_semi")


def linear_runs(children: DataFrame, chained: DataFrame) -> DataFrame:
    """Linear members (owner, place, node, linear) next to another linear one that an edge of ``chained`` (src, dst) ties them to: node."""
    order = Window.partitionBy("owner").orderBy("place", "node")
    pairs = children.select("node", "linear", F.lag("node").over(order).alias("src"), F.lag("linear").over(order).alias("before"))
    tied = pairs.where("linear and before").select("src", F.col("node").alias("dst")).join(chained.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    return tied.select(F.col("src").alias("node")).union(tied.select("dst")).distinct()
