"""Iterative graph operators over edge tables (src, dst).

Loops are semi-naive: each round joins only what the last one found, anti-joins it with what is known, and is written to the
shared folder, which cuts the lineage.  Nothing but counts comes to the driver.  ``partition`` columns (such as a repository)
may be carried by putting them into the keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.session import bucketed, materialised, partitions, ship

#: Rounds of HITS from one scaling to the next: 10 sums of products, so that degrees of 10^20 would still be in range.
UNSCALED = 5
#: Edges of a component that one task holds at most, about 50 bytes each.
WHOLE = 2_000_000
#: Edges that one task looks for cycles in at most.
REST = 500_000
#: Sources whose hidden paths one row finds.
WALKS = 500


def transitive_closure(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """All pairs (src, dst) with a path of one edge or more; cycles reach themselves."""
    step = materialised(edges.select("src", "dst").distinct())
    known = frontier = step
    for _ in range(rounds):
        ahead = frontier.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct()
        frontier = materialised(ahead.join(known, ["src", "dst"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = known.union(frontier)
    raise RuntimeError("closure: rounds exceeded")


def doubled_closure(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """The same pairs by joining the closure with itself: about log2(longest path) rounds, for deep graphs."""
    known = materialised(edges.select("src", "dst").distinct())
    count = known.count()
    for _ in range(rounds):
        twice = known.join(known.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst"))
        known = materialised(known.union(twice).distinct())
        count, last = known.count(), count
        if count == last:
            return known
    raise RuntimeError("closure: rounds exceeded")


def bfs_levels(edges: DataFrame, roots: DataFrame, rounds: int = 1000) -> DataFrame:
    """Least number of edges from any root (node) to each node: node, level."""
    known = frontier = materialised(roots.select("node").distinct().withColumn("level", F.lit(0)))
    step = edges.select(F.col("src").alias("node"), "dst")
    for level in range(1, rounds):
        ahead = frontier.join(step, "node").select(F.col("dst").alias("node")).distinct()
        frontier = materialised(ahead.join(known, "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return known
        known = known.union(frontier)
    raise RuntimeError("bfs: rounds exceeded")


def hidden_paths(edges: DataFrame, visible: DataFrame, interior: int = 8) -> DataFrame:
    """Best path over hidden nodes between visible ones without a direct edge: src, dst, hops, path (``a,b`` of hidden nodes).

    Best is shortest, then least by the text of the path; at most ``interior`` hidden nodes lie between.  In connected components of at
    most ``WHOLE`` edges ``WALKS`` sources walk in one row, and what they meet is written nowhere; larger components, and all where a name has
    a character up to the comma, are walked in loops over tables.
    """
    step = materialised(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    shown = materialised(visible.select("node").distinct())
    labels = connected_components(step)
    ends = step.join(labels.withColumnRenamed("node", "src"), "src")
    odd = F.max(F.col("src").cast("string").rlike("[\\x00-,]") | F.col("dst").cast("string").rlike("[\\x00-,]"))
    sizes = ends.groupBy("component").agg(F.count("*").alias("n"), odd.alias("odd"))
    large = materialised(sizes.where((F.col("n") > WHOLE) | F.col("odd")).select("component"))
    found = _hidden_paths_within(ends.join(large, "component", "left_anti"), labels.join(shown, "node").join(large, "component", "left_anti"), interior)
    if not large.isEmpty():
        spread = ends.join(large, "component", "left_semi").select("src", "dst")
        found = found.unionByName(_spread_hidden_paths(spread, shown, labels, interior))
    return found


def _hidden_paths_within(edges: DataFrame, shown: DataFrame, interior: int) -> DataFrame:
    """The same within components, of edges (component, src, dst) and visible nodes (component, node)."""
    ship(edges.sparkSession)
    kind = edges.schema["src"].dataType.simpleString()
    graphs = edges.groupBy("component").agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"))
    walks = shown.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("shown"))
    parts = F.sequence(F.lit(0), F.ceil(F.size("shown") / WALKS).cast("int") - 1)
    rows = graphs.join(walks, "component").select("src", "dst", "shown", F.explode(parts).alias("part"))
    dealt = rows.repartition(8 * partitions(edges.sparkSession))
    return dealt.mapInArrow(_walks(interior, WALKS), f"src {kind}, dst {kind}, hops int, path string")


def _rows_of(starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted edges those that begin ``at`` these nodes, one node after the other, and the place of each one's node."""
    n = ends[at] - starts[at]
    place = np.repeat(np.arange(len(at)), n)
    return np.arange(len(place)) + np.repeat(starts[at] - np.cumsum(n) + n, n), place


def _first(values: np.ndarray) -> np.ndarray:
    """Places at which a value comes first, ascending."""
    return np.sort(np.unique(values, return_index=True)[1])


def _walks(interior: int, walks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes are numbered by their text.  A layer has its nodes in order of their best paths, so that of what several lead to the first
    is best, and the next layer comes in order."""

    def of(srcs: pa.Array, dsts: pa.Array, shown: pa.Array, part: int) -> Iterator[pa.RecordBatch]:
        nodes = pa.concat_arrays([srcs, dsts]).unique()
        names = nodes.cast(pa.string())
        order = pc.array_sort_indices(names)
        nodes, names = nodes.take(order), names.take(order)
        src, dst = (pc.index_in(c, nodes).to_numpy() for c in (srcs, dsts))
        sources = pc.index_in(shown, nodes).to_numpy()
        seen = np.zeros(len(nodes), bool)
        seen[sources] = True
        steps = []
        for some in (~seen[dst], seen[dst]):
            k = np.lexsort((dst[some], src[some]))
            steps.append((dst[some][k], *(np.searchsorted(src[some][k], np.arange(len(nodes)), side) for side in ("left", "right"))))
        (inner, *inner_at), (outer, *outer_at) = steps
        for source in sources[part * walks : (part + 1) * walks]:
            met, known = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
            met[source] = True
            met[outer[outer_at[0][source] : outer_at[1][source]]] = True
            layer = inner[inner_at[0][source] : inner_at[1][source]]
            paths = layer[None]
            for hops in range(1, interior + 1):
                known[layer] = True
                edge, place = _rows_of(*outer_at, layer)
                new = ~met[outer[edge]]
                ends, place = outer[edge][new], place[new]
                first = _first(ends)
                ends, place = ends[first], place[first]
                if len(ends):
                    met[ends] = True
                    path = pc.binary_join_element_wise(*[names.take(pa.array(p[place])) for p in paths], ",") if hops > 1 else names.take(pa.array(paths[0][place]))
                    columns = [nodes.take(pa.array(np.full(len(ends), source))), nodes.take(pa.array(ends)), pa.array(np.full(len(ends), hops, np.int32)), path]
                    yield pa.RecordBatch.from_arrays(columns, names=["src", "dst", "hops", "path"])
                if hops == interior or met[sources].all():
                    break
                edge, place = _rows_of(*inner_at, layer)
                new = ~known[inner[edge]]
                ahead, place = inner[edge][new], place[new]
                first = _first(ahead)
                layer, paths = ahead[first], np.vstack([paths[:, place[first]], ahead[first]])
                if not len(layer):
                    break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from of(*[batch.column(c)[k].values for c in range(3)], batch.column(3)[k].as_py())

    return run


def _spread_hidden_paths(step: DataFrame, visible: DataFrame, labels: DataFrame, interior: int) -> DataFrame:
    """The same in loops over tables.  A node that has met all other visible ones of its undirected component goes no further: what it
    could still reach, it has by a shorter path."""
    shown = visible.select(F.col("node").alias("src")).distinct()
    seen = visible.select(F.col("node").alias("dst")).distinct()
    inner = materialised(step.join(seen, "dst", "left_anti"))  # edges to hidden nodes
    outer = materialised(step.join(seen, "dst", "left_semi"))  # edges to visible nodes
    within = labels.join(shown.withColumnRenamed("src", "node"), "node")
    others = within.groupBy("component").agg((F.count("*") - 1).alias("others"))
    others = materialised(within.join(others, "component").select(F.col("node").alias("src"), "others"))
    direct = step.join(shown, "src", "left_semi").join(seen, "dst", "left_semi").where("src <> dst")
    best = direct.withColumns({"hops": F.lit(0), "path": F.lit("")})
    frontier = materialised(inner.join(shown, "src", "left_semi").select("src", F.col("dst").alias("at"), F.col("dst").cast("string").alias("path")))
    known = frontier.select("src", "at")
    for hops in range(1, interior + 1):
        ends = frontier.join(outer.select(F.col("src").alias("at"), "dst"), "at").where("src <> dst").groupBy("src", "dst").agg(F.min("path").alias("path"))
        best = best.unionByName(materialised(ends.join(best, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops))))
        if hops == interior:
            break
        met = best.groupBy("src").agg(F.count("*").alias("met"))
        left = others.join(met, "src", "left").where("coalesce(met, 0) < others").select("src")
        ahead = frontier.join(left, "src", "left_semi").join(inner.select(F.col("src").alias("at"), F.col("dst").alias("next")), "at").where("src <> next")
        ahead = ahead.select("src", F.col("next").alias("at"), F.concat("path", F.lit(","), F.col("next").cast("string")).alias("path")).groupBy("src", "at").agg(F.min("path").alias("path"))
        frontier = materialised(ahead.join(known, ["src", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.union(frontier.select("src", "at"))
    return best.where("hops > 0").select("src", "dst", "hops", "path")


def longest_depth(edges: DataFrame) -> DataFrame:
    """Longest path (edges) that ends in each node: node, depth.  Nodes on cycles, or behind them, all have the greatest depth that
    any node, they too, has by paths without such nodes before the last.

    Nodes are peeled off: those that nothing left leads to are final, and each edge is used once, when its source is.  Edges lie in
    buckets by source and do not move; of nodes only those that wait go from round to round.
    """
    step = bucketed(edges.where("src <> dst").select("src", "dst"), "src")
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("into"), (F.col("src") == F.col("dst")).alias("loop"))
    ends = ends.union(edges.select("dst", (F.col("src") != F.col("dst")).cast("int"), F.lit(False)))
    left = materialised(ends.groupBy("node").agg(F.sum("into").alias("left"), F.max("loop").alias("loop")).withColumn("met", F.lit(0)))
    depth, out = 0, left.limit(0).select("node", F.lit(0).alias("depth"))
    while True:
        ready = left.where("left = 0 and not loop").select("node")
        if ready.isEmpty():
            break
        out = out.union(ready.withColumn("depth", F.lit(depth)))
        used = ready.select(F.col("node").alias("src")).join(step, "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("used"))
        depth += 1
        met = F.when(F.col("used").isNull(), F.col("met")).otherwise(depth).alias("met")
        left = materialised(left.where("left > 0 or loop").join(used, "node", "left").select("node", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), "loop", met))
    most = max(depth - 1, left.agg(F.max("met")).first()[0] or 0)
    return out.unionByName(left.select("node", F.lit(most).alias("depth")))


def strong_components(edges: DataFrame) -> DataFrame:
    """Least node of the strongly connected component of each node that has others in its own: node, component.

    Colours, the greatest node that leads to a node, are spread along edges and jump to the colour of their colour; what leads
    back to the node that gave a colour, among nodes of that colour, is a component.  Edges that cannot lie on a cycle (from
    nodes that nothing leads to, to nodes that lead nowhere, between colours) go, and the rest is coloured again until none is left.
    A rest of at most ``REST`` edges is one task's, as soon as it is that small, so that its chains and cycles cost no jobs.
    """
    step = edges.where("src <> dst").select("src", "dst")
    found: list[DataFrame] = []
    count = step.count()
    plain = step.schema["src"].dataType.typeName() in ("string", "long", "integer")
    while count:
        if plain and count <= REST:
            ship(edges.sparkSession)
            kind = step.schema["src"].dataType.simpleString()
            found.append(materialised(step.groupBy().applyInArrow(_strong_within, f"node {kind}, component {kind}")))
            break
        last = count + 1
        while count < last and not (plain and count <= REST):
            kept = step.join(step.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(step.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            step, last = materialised(kept), count
            count = step.count()
        if not count or count < last:
            continue
        # Each node is led to by then, so that the first round needs no join.
        colour, moved = materialised(step.groupBy(F.col("dst").alias("node")).agg(F.max("src").alias("given")).select("node", F.greatest("node", "given").alias("colour"))), True
        while moved:
            spread = step.join(colour.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("given"))
            met = colour.join(spread, "node", "left").select("node", F.col("colour").alias("old"), F.greatest("colour", F.coalesce("given", "colour")).alias("colour"))
            jump = colour.select(F.col("node").alias("colour"), F.col("colour").alias("further"))
            now = materialised(met.join(jump, "colour", "left").select("node", "old", F.greatest("colour", F.coalesce("further", "colour")).alias("colour")))
            moved, colour = not now.where("old <> colour").isEmpty(), now.select("node", "colour")
        tint = lambda c: colour.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
        inner = materialised(step.join(tint("src"), "src").join(tint("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"))
        members = frontier = materialised(colour.where("node = colour"))
        while not frontier.isEmpty():
            back = frontier.select(F.col("node").alias("dst"), "colour").join(inner, "dst").select(F.col("src").alias("node"), "colour").distinct()
            frontier = materialised(back.join(members, "node", "left_anti"))
            members = members.union(frontier)
        members = materialised(members)
        least = members.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
        found.append(materialised(members.join(least, "colour").select("node", "component")))
        rest = inner.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti")
        step = materialised(rest)
        count = step.count()
    out = edges.sparkSession.createDataFrame([], edges.select(F.col("src").alias("node"), F.col("src").alias("component")).schema)
    for more in found:
        out = out.unionByName(more)
    return out


def _strong_within(edges: pa.Table) -> pa.Table:
    """The same of edges in one place: a walk in depth with a stack of what is open, where each node's number sinks to the least that it leads back to."""
    src, dst = (edges.column(c).combine_chunks() for c in ("src", "dst"))
    nodes = pa.concat_arrays([src, dst]).unique()
    nodes = nodes.take(pc.array_sort_indices(nodes))
    s, d = (pc.index_in(c, nodes).to_numpy() for c in (src, dst))
    order, n = np.argsort(s, kind="stable"), len(nodes)
    after, at = d[order].tolist(), np.searchsorted(s[order], np.arange(n + 1)).tolist()
    number, low, closed, label, stack, count = [0] * n, [0] * n, [False] * n, np.full(n, -1), [], 0
    todo = at[:n]
    for root in range(n):
        way = [] if number[root] else [root]
        while way:
            node = way[-1]
            if not number[node]:
                count += 1
                number[node] = low[node] = count
                stack.append(node)
            if todo[node] < at[node + 1]:
                to = after[todo[node]]
                todo[node] += 1
                if not number[to]:
                    way.append(to)
                elif not closed[to]:
                    low[node] = min(low[node], number[to])
                continue
            way.pop()
            if way:
                low[way[-1]] = min(low[way[-1]], low[node])
            if low[node] == number[node]:
                members = [stack.pop()]
                while members[-1] != node:
                    members.append(stack.pop())
                for m in members:
                    closed[m] = True
                if len(members) > 1:
                    label[members] = min(members)
    found = np.flatnonzero(label >= 0)
    return pa.table({"node": nodes.take(pa.array(found)), "component": nodes.take(pa.array(label[found]))})


def reach_sizes(edges: DataFrame, itself: bool = True) -> DataFrame:
    """How many nodes each node reaches over one edge or more: node, reach; nodes that lead nowhere are left out.  A node on a cycle
    reaches itself, which is counted if ``itself``.

    Components are closed over, not nodes: one counts with its size, and all its nodes reach the same.
    """
    step = materialised(edges.select("src", "dst").distinct())
    strong = materialised(strong_components(step))
    nodes = step.select(F.col("src").alias("node")).union(step.select("dst")).distinct()
    member = materialised(nodes.join(strong, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    size = materialised(member.groupBy("component").agg(F.count("*").alias("size")))
    end = lambda c: member.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    between = materialised(step.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_component").alias("src"), F.col("dst_component").alias("dst")).distinct())
    closed = sized_closure(between.where("src <> dst"), size.select(F.col("component").alias("dst"), "size"))
    own = between.where("src = dst").join(size.withColumnRenamed("component", "src"), "src").select("src", "dst", (F.col("size") - (0 if itself else 1)).alias("size"))
    reach = closed.union(own).groupBy(F.col("src").alias("component")).agg(F.sum("size").alias("reach"))
    return member.join(reach, "component").select("node", "reach")


def sized_closure(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """All pairs with a path, of distinct edges without cycles, and the size (dst, size) of where it leads: src, dst, size.

    Nodes take their turn by the longest way on that they have, when all they lead to is closed, so that each closes once and no
    pair is looked up among those known.  Where many nodes have their turn little is known, and where much is known few have it: then
    these are broadcast and what is known is read, not shuffled.
    """
    turns = longest_depth(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("node").alias("src"), F.col("depth").alias("turn"))
    step = materialised(edges.join(turns, "src").join(sizes, "dst").select("src", "dst", "size", "turn"))
    known = step.limit(0).select("src", "dst", "size")
    for turn in range(1, (step.agg(F.max("turn")).first()[0] or 0) + 1):
        now = step.where(F.col("turn") == turn)
        further = now.select("src", F.col("dst").alias("via")).join(known.withColumnRenamed("src", "via"), "via").select("src", "dst", "size")
        known = known.union(materialised(now.select("src", "dst", "size").union(further).distinct()))
    return known


def mutual_reach(closure: DataFrame) -> DataFrame:
    """Pairs that reach each other, a < b, from a closure: nodes of one strongly connected component."""
    back = closure.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure.where("src < dst").join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Least node of the undirected component of each node: node, component.

    Labels spread to neighbours and jump to the label of their label, so that rounds grow with the logarithm of long chains.
    """
    both = materialised(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near")).select("node", F.least("node", "near").alias("component"))
    labels, last = materialised(labels), None
    for _ in range(rounds):
        spread = both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("near")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("near").alias("near"))
        met = labels.join(spread, "node").select("node", F.least("component", "near").alias("component"))
        jump = met.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = materialised(met.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component")))
        now = labels.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]
        if now == last:
            return labels
        last = now
    raise RuntimeError("components: rounds exceeded")


def hits(edges: DataFrame, iterations: int = 50, digits: int = 6) -> DataFrame:
    """Hub and authority of weighted edges (src, dst, weight of zero or more), after one round or more: node, hub, authority.

    Authority is the weighted sum of hubs, a hub the weighted sum of the new authorities; both are scaled to a sum of one (left
    as they are if the sum is not positive).  A round is linear and no edge leads out of a connected component, so that scaling waits
    for the end and components are looked at by themselves: those of at most ``WHOLE`` edges go through all rounds in one job,
    larger ones through loops over tables.  Every ``UNSCALED`` rounds powers of two are set aside, which are brought together last.
    Rounded half to even.
    """
    edges = materialised(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    known = edges.where("src is not null and dst is not null and weight is not null")
    # whoever leads to a node is linked by the least of them, and there are few of these
    near = materialised(known.groupBy("dst").agg(F.min("src").alias("near")))
    linked = known.join(near, "dst").select("src", F.col("near").alias("dst")).union(near.select("dst", "near")).distinct()
    labels = connected_components(linked).select(F.col("node").alias("src"), "component")
    large = materialised(known.groupBy("src").agg(F.count("*").alias("n")).join(labels, "src").groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") > WHOLE).select("component"))
    placed = known.join(labels, "src")
    ship(edges.sparkSession)
    within = placed.join(F.broadcast(large), "component", "left_anti").groupBy("component")
    raw = within.applyInArrow(_hits_within(iterations), f"node {edges.schema['src'].dataType.simpleString()}, hub double, hub_bits long, authority double, authority_bits long")
    if not large.isEmpty():
        raw = raw.unionByName(_spread_hits(placed.join(F.broadcast(large), "component", "left_semi"), iterations))
    raw = materialised(raw)
    most = raw.agg(*[F.max(F.when(F.col(c) > 0, F.col(f"{c}_bits"))).alias(f"{c}_most") for c in ("hub", "authority")])
    value = lambda c: F.coalesce(F.col(c) * F.pow(F.lit(2.0), F.col(f"{c}_bits") - F.col(f"{c}_most")), F.lit(0.0)).alias(c)
    found = raw.crossJoin(F.broadcast(most)).select(F.col("node").alias("known"), value("hub"), value("authority"))
    even = materialised(nodes.join(found, nodes.node == found.known, "left").fillna(0.0, ["hub", "authority"]))

    def scaled(name: str) -> Column:
        total = even.agg(F.sum(name)).scalar()
        return F.bround(F.when(total > 0, F.col(name) / total).otherwise(F.col(name)), digits).alias(name)

    return even.select("node", scaled("hub"), scaled("authority"))


def _hits_within(iterations: int) -> Callable[[pa.Table], pa.Table]:
    """All rounds over the edges of one component; values are to be multiplied by two to the power of their bits."""

    def run(edges: pa.Table) -> pa.Table:
        coded = [edges.column(c).combine_chunks().dictionary_encode() for c in ("src", "dst")]
        (sources, s), (targets, d) = ((c.dictionary, c.indices.to_numpy()) for c in coded)
        weight, hub, bits = edges.column("weight").to_numpy(), np.ones(len(sources)), 0
        for k in range(iterations):
            if k % UNSCALED == 0:
                more = math.frexp(hub.max())[1]
                hub, bits = np.ldexp(hub, -more), bits + more
            authority = np.bincount(d, weight * hub[s], len(targets))
            hub = np.bincount(s, weight * authority[d], len(sources))
        nodes = pa.concat_arrays([sources, targets]).unique()
        found = {"node": nodes}
        for name, of, values in (("hub", sources, hub), ("authority", targets, authority)):
            more, even = math.frexp(values.max())[1], np.zeros(len(nodes))
            even[pc.index_in(of, nodes).to_numpy()] = np.ldexp(values, -more)
            found |= {name: even, f"{name}_bits": np.full(len(nodes), bits + more)}
        return pa.table(found)

    return run


def _spread_hits(edges: DataFrame, iterations: int) -> DataFrame:
    """The same of components of any size, round by round: edges lie in buckets by dst, so that a round joins them twice without a
    shuffle as long as the hubs are few enough for Spark to broadcast."""
    step = bucketed(edges.select("src", "dst", "weight"), "dst")
    hub, bits = materialised(step.select("src").distinct().withColumn("hub", F.lit(1.0))), 0
    bits_of = lambda scores, name: math.frexp(scores.agg(F.max(name)).first()[0] or 0.0)[1]
    for k in range(iterations):
        if k % UNSCALED == 0 and k:
            more = bits_of(hub, "hub")
            hub, bits = hub.withColumn("hub", F.col("hub") * 2.0**-more), bits + more
        authority = step.join(hub, "src").groupBy("dst").agg(F.sum(F.col("weight") * F.col("hub")).alias("authority"))
        if k + 1 == iterations:
            authority = materialised(authority)
        hub = materialised(step.join(authority.hint("shuffle_hash"), "dst").groupBy("src").agg(F.sum(F.col("weight") * F.col("authority")).alias("hub")))
    both = hub.withColumnRenamed("src", "node").join(authority.withColumnRenamed("dst", "node"), "node", "full")
    even = lambda name, more: [(F.coalesce(name, F.lit(0.0)) * 2.0**-more).alias(name), F.lit(bits + more).cast("long").alias(f"{name}_bits")]
    return both.select("node", *even("hub", bits_of(hub, "hub")), *even("authority", bits_of(authority, "authority")))


def edge_contract(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """Edges between hosts (node, host) of their ends; nodes without host stay; self loops and repetitions go."""
    a = hosts.select(F.col("node").alias("src"), F.col("host").alias("src_host"))
    b = hosts.select(F.col("node").alias("dst"), F.col("host").alias("dst_host"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left")
    return moved.select(F.coalesce("src_host", "src").alias("src"), F.coalesce("dst_host", "dst").alias("dst")).where("src <> dst").distinct()


def bridged(edges: DataFrame, dropped: DataFrame) -> DataFrame:
    """Edges without the dropped nodes (node): two others are joined where a path over dropped nodes alone, in cycles or not, joins them.

    That is what dropping one node after the other gives, in any order.  No self loops.
    """
    gone = materialised(dropped.select("node").distinct())
    lost = lambda c, mark: gone.select(F.col("node").alias(c), F.lit(True).alias(mark))
    marked = edges.select("src", "dst").distinct().join(lost("src", "from_gone"), "src", "left").join(lost("dst", "to_gone"), "dst", "left")
    marked = materialised(marked.select("src", "dst", F.col("from_gone").isNotNull().alias("from_gone"), F.col("to_gone").isNotNull().alias("to_gone")))
    ahead = marked.where("from_gone").select(F.col("src").alias("via"), F.col("dst").alias("next"), "to_gone")
    inner = ahead.where("to_gone").drop("to_gone")
    met = frontier = marked.where("not from_gone and to_gone").select("src", F.col("dst").alias("via"))
    while not frontier.isEmpty():
        further = frontier.join(inner, "via").select("src", F.col("next").alias("via")).distinct()
        frontier = materialised(further.join(met, ["src", "via"], "left_anti"))
        met = met.union(frontier)
    over = met.join(ahead.where("not to_gone"), "via").select("src", F.col("next").alias("dst"))
    return marked.where("not from_gone and not to_gone").select("src", "dst").union(over).where("src <> dst").distinct()


def unary_chains(edges: DataFrame, least: int = 3, rounds: int = 40, barred: DataFrame | None = None) -> DataFrame:
    """Maximal runs of nodes with one way in and one way on: head, node, position, length; runs of ``least`` nodes or more.

    A node continues the run of its predecessor if that has one successor and it one predecessor.  Positions are found by
    pointer doubling, and nodes whose head is known leave the working set; nodes of a cycle are in no run, nor are those of
    ``barred`` (node), whose edges count nevertheless.  Joins are merged: broadcasts of all runs would pass through the driver.
    """
    alone = lambda of, other: edges.groupBy(of).agg(F.min(other).alias(other), F.max(other).alias("last"), F.bool_and(F.col(other).isNotNull()).alias("whole")).where(f"whole and {other} = last").select("src", "dst")
    tied = alone("src", "dst").join(alone("dst", "src").withColumnRenamed("src", "only").hint("merge"), "dst").where("src = only").select("src", "dst")
    if barred is not None:
        tied = tied.join(barred.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti").join(barred.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti")
    known = materialised(tied.select(F.col("dst").alias("node"), F.col("src").alias("head"), F.lit(1).cast("long").alias("position"), F.lit(False).alias("done")))
    left, found = known, known.limit(0)
    for _ in range(rounds):
        jump = known.select(F.col("node").alias("head"), F.col("head").alias("further"), F.col("position").alias("more"), F.col("done").alias("ends"))
        on = left.select("node", "head", "position").join(jump.hint("merge"), "head", "left")
        at = materialised(on.select("node", F.coalesce("further", "head").alias("head"), (F.col("position") + F.coalesce("more", F.lit(0))).alias("position"), F.coalesce("ends", F.lit(True)).alias("done")))
        some, all_ = at.agg(F.bool_or("done"), F.bool_and("done")).first()
        if not some:  # nothing is left, or cycles alone: of a run some nodes get their head each round
            break
        found, left = found.union(at.where("done")), at.where("not done")
        if all_:
            break
        known = found.union(left)
    sizes = found.groupBy("head").agg((F.count("*") + 1).alias("length")).where(F.col("length") >= least)
    first = sizes.select("head", F.col("head").alias("node"), F.lit(0).cast("long").alias("position"), "length")
    return found.join(sizes.hint("merge"), "head").select("head", "node", "position", "length").union(first)


def reach_counts(closure: DataFrame) -> DataFrame:
    """Distinct nodes that each node reaches: node, reach."""
    return closure.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("reach"))
