"""What a container shows: order, tails, head and kind of its body, and what is wrong with a structure.

Rows ``contained`` are (node, container) as in ``containment``, edges (src, dst).  Only the order within one body, in which every step
depends on the last, runs in Python: a row is the members of one container, with three numbers or names each, and many rows make a batch.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from forkline.operators.containment import descendants
from forkline.operators.graph import bfs_levels
from forkline.session import materialised, ship


def members(contained: DataFrame) -> DataFrame:
    """Members of each container: owner, node."""
    return contained.where("container is not null").select(F.col("container").alias("owner"), "node").distinct()


def inner_edges(contained: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between members of one container, as often as given: owner, src, dst."""
    body = members(contained)
    return edges.select("src", "dst").join(body.withColumnRenamed("node", "src"), "src").join(body.withColumnRenamed("node", "dst"), ["owner", "dst"]).select("owner", "src", "dst")


def _ordered(body: list) -> list:
    """Members whose predecessors are placed, least (file, line, node) first; members of cycles come last in that order."""
    key = {m.node: (m.file, m.line, m.node) for m in body}
    ahead = {m.node: [t for t in m.targets if t in key] for m in body}
    waits = dict.fromkeys(key, 0)
    for targets in ahead.values():
        for t in targets:
            waits[t] += 1
    ready = [key[n] for n, left in waits.items() if left == 0]
    heapq.heapify(ready)
    order = []
    while ready:
        node = heapq.heappop(ready)[2]
        order.append(node)
        for t in ahead[node]:
            waits[t] -= 1
            if waits[t] == 0:
                heapq.heappush(ready, key[t])
    return order + [k[2] for k in sorted(key[n] for n in set(key) - set(order))]


def body_order(contained: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """Topological order of each body: owner, node, place from 0; ties by ``places`` (node, file, line; nulls as empty and 0)."""
    ship(contained.sparkSession)
    out = inner_edges(contained, edges).groupBy("owner", F.col("src").alias("node")).agg(F.collect_set("dst").alias("targets"))
    rows = members(contained).join(places.select("node", "file", "line"), "node", "left").join(out, ["owner", "node"], "left")
    kind = contained.schema["node"].dataType
    targets = F.coalesce("targets", F.array().cast(ArrayType(kind))).alias("targets")
    body = F.collect_list(F.struct("node", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), targets))
    order = F.udf(_ordered, ArrayType(kind), useArrow=True)
    return rows.groupBy("owner").agg(body.alias("body")).select("owner", F.posexplode(order("body")).alias("place", "node")).select("owner", "node", "place")


def body_tails(contained: DataFrame, edges: DataFrame) -> DataFrame:
    """Members that lead nowhere or out of their body: owner, node."""
    body = members(contained)
    out = edges.select(F.col("src").alias("node"), "dst").distinct()
    inside = body.join(out, "node").join(body.select("owner", F.col("node").alias("dst")), ["owner", "dst"], "left_semi")
    counted = body.join(out, "node", "left").groupBy("owner", "node").agg(F.count("dst").alias("n"))
    within = inside.groupBy("owner", "node").agg(F.count("*").alias("m"))
    return counted.join(within, ["owner", "node"], "left").where("n = 0 or n > coalesce(m, 0)").select("owner", "node")


def headless(contained: DataFrame, edges: DataFrame) -> DataFrame:
    """Members that no edge from their container, or from what lies in it at any depth, leads to: owner, node."""
    body = members(contained)
    into = materialised(edges.select("src", F.col("dst").alias("node")).distinct().join(body, "node").select("owner", "node", "src"))
    lies = descendants(contained, into.where("src <> owner").select(F.col("src").alias("node"), F.col("owner").alias("ancestor")))
    inside = into.join(lies.select(F.col("node").alias("src"), F.col("ancestor").alias("owner")), ["src", "owner"], "left_semi").select("owner", "node")
    return body.join(into.where("src = owner").select("owner", "node").union(inside), ["owner", "node"], "left_anti")


def loose(contained: DataFrame, edges: DataFrame) -> DataFrame:
    """Bodies with fewer edges between members than a tree over them has: owner, size, inner."""
    sizes = members(contained).groupBy("owner").agg(F.count("*").alias("size")).where("size > 1")
    inner = inner_edges(contained, edges).groupBy("owner").agg(F.count("*").alias("inner"))
    return sizes.join(inner, "owner", "left").select("owner", "size", F.coalesce("inner", F.lit(0)).alias("inner")).where("inner < size - 1")


def body_kinds(contained: DataFrame, edges: DataFrame, order: DataFrame) -> DataFrame:
    """Kind and head of each body: owner, kind, head.

    ``list`` without head, if a member is headless or the body is loose; else ``flow``, with the least member that the container
    leads to, or the first in ``order`` (owner, node, place).
    """
    listed = headless(contained, edges).select("owner").union(loose(contained, edges).select("owner")).distinct().withColumn("listed", F.lit(True))
    called = edges.select(F.col("src").alias("owner"), F.col("dst").alias("node")).join(members(contained), ["owner", "node"], "left_semi").groupBy("owner").agg(F.min("node").alias("called"))
    first = order.groupBy("owner").agg(F.min_by("node", "place").alias("first"))
    rows = first.join(called, "owner", "left").join(listed, "owner", "left")
    return rows.select("owner", F.when(F.col("listed"), "list").otherwise("flow").alias("kind"), F.when(F.col("listed").isNull(), F.coalesce("called", "first")).alias("head"))


def border_edges(contained: DataFrame, tails: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that leave a body from members that are none of its tails (owner, node): owner, src, dst."""
    plain = members(contained).join(tails, ["owner", "node"], "left_anti").select("owner", F.col("node").alias("src"))
    out = edges.select("src", "dst").join(plain, "src")
    return out.join(members(contained).withColumnRenamed("node", "dst"), ["owner", "dst"], "left_anti").select("owner", "src", "dst")


def structure_problems(contained: DataFrame, root) -> DataFrame:
    """Faults of a containment under one root: problem, node.

    ``missing`` container, ``cycle`` (the node lies in itself), ``root`` (without container, and not the root asked for), ``orphan``
    (not in the root at any depth).
    """
    contained = materialised(contained.select("node", "container"))
    up = contained.where("container is not null")
    nodes = contained.select("node").distinct()
    missing = up.join(nodes.select(F.col("node").alias("container")), "container", "left_anti").select("node").distinct()
    cycle = descendants(contained, nodes.withColumn("ancestor", F.col("node"))).select("node")
    roots = nodes.join(up.select("node"), "node", "left_anti").where(F.col("node") != F.lit(root))
    reached = bfs_levels(up.select(F.col("container").alias("src"), F.col("node").alias("dst")), nodes.where(F.col("node") == F.lit(root)))
    orphan = nodes.join(reached, "node", "left_anti")
    named = [df.select(F.lit(word).alias("problem"), "node") for word, df in (("missing", missing), ("cycle", cycle), ("root", roots), ("orphan", orphan))]
    return named[0].union(named[1]).union(named[2]).union(named[3])


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) of which an end is no node."""
    known = nodes.select("node").distinct()
    whole = edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return edges.select("src", "dst").distinct().join(whole.select("src", "dst"), ["src", "dst"], "left_anti")


def metrics(nodes: DataFrame, contained: DataFrame, edges: DataFrame) -> DataFrame:
    """Histograms of a diagram's nodes (node, kind, level), and counts of its gaps: metric, value, n."""
    sizes = members(contained).groupBy("owner").agg(F.count("*").alias("size"))
    histogram = lambda df, name, column: df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "value", "n")
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit("gaps").alias("metric"), F.lit(name).alias("value"), "n")
    rows = histogram(nodes, "kind", "kind").union(histogram(nodes, "level", "level")).union(histogram(sizes, "body", "size"))
    return rows.union(total(headless(contained, edges), "entry")).union(total(loose(contained, edges), "cohesion")).union(total(dangling(edges, nodes), "dangling"))
