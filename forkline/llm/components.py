"""Connected components by alternating large-star and small-star steps.

Each step is a minimum over neighbours, pre-aggregated before its shuffle and joined back to the edges.  The minima of
vertices with very many edges are broadcast, a bounded number of rows, so that a hub's edges never gather in one task;
about log(longest path) rounds are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.llm.skew import hot_join
from forkline.session import materialised


def _star(edges: DataFrame, larger: bool, total: int) -> DataFrame:
    """edges (a, b), a > b.  larger: each vertex hands its larger neighbours to the least of all; else its smaller ones and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count("*").alias("edges"))
    met = hot_join(both, materialised(least), ["a"], "edges", total)
    if larger:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    return met.select("b", "least").union(met.select("a", "least")).toDF("a", "b").where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Label every vertex of ``links`` (a, b: long) with the least vertex it can reach: columns node, label.

    Self-links and null ends are ignored; repeated and reversed links count once; an empty table gives an empty result.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialised(edges)
    total = edges.count()
    last = None
    for _ in range(rounds if total else 0):
        edges = materialised(_star(materialised(_star(edges, True, 2 * total)), False, total))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        if total:
            raise RuntimeError(f"components: not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
