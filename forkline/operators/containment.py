"""Containers, owners and entries: what lies in what, who comes first, what may be folded.

Loops go level by level, are written to the shared folder and raise if they do not end; all of them join by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forkline.operators.graph import bfs_levels, reach_sizes
from forkline.session import materialised


def _edges(contained: DataFrame) -> DataFrame:
    known = contained.select(F.col("node").alias("container"))
    return contained.join(known, "container", "left_semi").select(F.col("container").alias("src"), F.col("node").alias("dst"))


def containment_depth(contained: DataFrame) -> DataFrame:
    """Least number of containers above each node: node, level.  Rows (node, container); several containers of a node are
    several rows, and a container that is null or no node is none.  Nodes of cycles without a way in are left out."""
    contained = materialised(contained.select("node", "container"))
    edges = materialised(_edges(contained))
    roots = contained.select("node").distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return bfs_levels(edges, roots)


def descendants(contained: DataFrame, asked: DataFrame, rounds: int = 1000) -> DataFrame:
    """Those pairs (node, ancestor) of ``asked`` where the node lies, at any depth, in the ancestor."""
    step = materialised(contained.select(F.col("node").alias("at"), "container").where("container is not null").distinct())
    left = materialised(asked.select("node", "ancestor", F.col("node").alias("at")).distinct())
    found, seen = None, left.where("at <> ancestor")  # a node of a cycle may come back to itself
    for _ in range(rounds):
        up = materialised(left.join(step, "at").select("node", "ancestor", F.col("container").alias("at")).distinct().join(seen, ["node", "ancestor", "at"], "left_anti"))
        hit = up.where("at = ancestor").select("node", "ancestor")
        found = hit if found is None else found.union(hit)
        left = up.where("at <> ancestor")
        if left.isEmpty():
            return found.distinct()
        seen = seen.union(left)
    raise RuntimeError("descendants: rounds exceeded")


def subtree_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct nodes reached from each node (node), itself left out: node, size."""
    count = reach_sizes(edges, itself=False).withColumnRenamed("reach", "size")
    return nodes.select("node").distinct().join(count, "node", "left").select("node", F.coalesce("size", F.lit(0)).alias("size"))


def nearest_above(edges: DataFrame, asked: DataFrame, kept: DataFrame, rounds: int = 1000) -> DataFrame:
    """For each asked node the nearest of ``kept`` (node) among itself and its callers, callers of callers and so on (edges
    src to dst); of several at one distance the least: node, nearest, distance.  Nodes without any are left out."""
    known = kept.select(F.col("node").alias("at")).distinct()
    step = materialised(edges.select(F.col("dst").alias("at"), "src").distinct())
    left = seen = materialised(asked.select("node", F.col("node").alias("at")).distinct())
    found = None
    for distance in range(rounds):
        hit = materialised(left.join(known, "at", "left_semi").groupBy("node").agg(F.min("at").alias("nearest")).withColumn("distance", F.lit(distance)))
        found = hit if found is None else found.union(hit)
        open_ = left.join(hit, "node", "left_anti")
        left = materialised(open_.join(step, "at").select("node", F.col("src").alias("at")).distinct().join(seen, ["node", "at"], "left_anti"))
        if left.isEmpty():
            return found
        seen = seen.union(left)
    raise RuntimeError("nearest_above: rounds exceeded")


def body_heads(members: DataFrame) -> DataFrame:
    """The first member of each owner by file, line and id (nulls as empty and 0): owner, head."""
    order = F.struct(F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), "id")
    return members.groupBy("owner").agg(F.min_by("id", order).alias("head"))


def owner_heads(members: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``body_heads``, of the members that no other member of their owner leads to; of all where each is led to."""
    place = members.select("id", "owner")
    inner = edges.where("src <> dst").join(place.withColumnRenamed("id", "src"), "src").join(place.select(F.col("id").alias("dst"), F.col("owner").alias("of")), "dst").where("owner = of")
    free = members.join(inner.select(F.col("dst").alias("id")), "id", "left_anti")
    first = body_heads(free)
    return first.union(body_heads(members.join(first, "owner", "left_anti")))


def filled(rows: DataFrame, budget: int, score: str, key: str) -> DataFrame:
    """Promoted rows (promoted: boolean), and as many others of the highest score, ties to the least key, as the budget leaves room for."""
    room = max(0, budget - rows.where("promoted").count())
    return rows.where("promoted").unionByName(rows.where("not promoted").orderBy(F.desc(score), key).limit(room))


def batches(rows: DataFrame, group: str, key: str, size: int = 20) -> DataFrame:
    """Column ``batch``: rows of a group by key, ``size`` to a batch, counted from 0."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1) / size))


def arm_reach(arms: DataFrame, utilities: DataFrame) -> DataFrame:
    """Components that an arm (site, idx, owner, component: a row each) reaches beside utilities (component) and its owner's own: site, idx, n.

    Arms that are dealt by site stay where they are; one pass counts, and an arm's components are a set in its row.
    """
    known = utilities.select("component", F.lit(True).alias("utility")).where("component is not null").distinct()
    told = F.when((F.col("component") != F.col("owner")) & F.col("utility").isNull(), F.col("component"))
    return arms.join(known, "component", "left").groupBy("site", "idx").agg(F.count_distinct(told).alias("n"))


def trivial_groups(entries: DataFrame, edges: DataFrame, telling: DataFrame) -> DataFrame:
    """Entries (node, root, routes) that reach nothing telling (node), two or more of one root folded into one: entry, routes.

    Others keep their own names.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    told = materialised(bfs_levels(back, telling.select("node")).select("node"))  # who leads to something telling
    alone = entries.join(told, "node", "left_anti")
    many = alone.groupBy("root").agg(F.count("*").alias("n"), F.sum("routes").alias("routes")).where("n > 1")
    folded = many.select(F.concat(F.lit("entry:trivial:"), "root").alias("entry"), "routes")
    rest = entries.join(told, "node", "left_semi").union(alone.join(many, "root", "left_anti").select(*entries.columns))
    return folded.union(rest.select(F.col("node").cast("string").alias("entry"), "routes"))
