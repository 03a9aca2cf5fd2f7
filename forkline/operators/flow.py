"""Facts condensed to a flow graph: nodes and edges, levels, layout and the conditions a graph must meet."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forkline.functions import text as T
from forkline.operators import graph
from forkline.session import materialised, ship

COLUMN, ROW = 260, 140
# Width and height of a node by its kind.
GEOMETRY = {"entry": (220, 64), "step": (200, 56), "decision": (180, 96), "effect": (180, 56), "outcome": (160, 48)}


@dataclass(frozen=True)
class Flow:
    nodes: DataFrame  # id, repo, kind, label, owner
    edges: DataFrame  # source, target, kind, arm_label, confidence


def condensed(analysis) -> Flow:
    """Steps are functions, decisions forks that matter, outcomes arms that leave, effects calls to the outside, entries handlers of routes.

    A call within an arm of a decision hangs on the decision, any other on its function.
    """
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    known = analysis.index.functions.select("repo", "fn").union(analysis.index.classes.select("repo", "cls"))
    fn = known.select(F.concat_ws("|", "repo", "fn").alias("fn_id"), "repo", "fn")
    decisions = analysis.verdicts.where("verdict = 'decision'").select("site", "repo", "owner")
    graph_edges = analysis.call_graph.select(F.col("src"), F.col("dst"))
    arms = analysis.arms.withColumn("site", F.concat_ws("|", "repo", "site")).join(decisions.select("site"), "site", "left_semi")
    spans = analysis.facts.where("kind = 'arm'").select(F.concat_ws("|", "repo", F.concat_ws(":", "owner", F.col("extra")[0], F.col("extra")[1])).alias("site"), F.col("ordinal").alias("idx"), F.col("extra")[2].cast("int").alias("lo"), F.col("extra")[3].cast("int").alias("hi"))
    inside = analysis.calls.join(analysis.targets.where("target not like 'ext:%'"), ["repo", "call"])
    by_line = arms.where("kind <> 'polymorphic'").join(spans, ["site", "idx"]).join(inside.select("repo", F.col("caller").alias("owner"), "line", "target"), ["repo", "owner"]).where("line between lo and hi").select("site", "repo", "owner", "label", "target")
    by_target = arms.where("kind = 'polymorphic'").join(inside.select("repo", F.concat_ws("|", "repo", "call").alias("site"), "target"), ["repo", "site"]).where(F.try_element_at(F.split("target", r"\."), F.lit(-2)) == F.col("label")).select("site", "repo", "owner", "label", "target")
    arm_edges = materialised(by_line.union(by_target).select(key("dec:", "site").alias("source"), F.concat(F.lit("step:"), "repo", F.lit("|"), "target").alias("target"), "label", F.concat_ws("|", "repo", "owner").alias("src"), F.concat_ws("|", "repo", "target").alias("dst")).distinct())
    leaving = arms.where("terminal in ('raises', 'returns')").select("repo", key("dec:", "site").alias("source"), F.concat(F.lit("out:"), "site", F.lit(":"), F.col("idx").cast("string")).alias("target"), "label", "terminal")
    plain = graph_edges.join(arm_edges.select("src", "dst"), ["src", "dst"], "left_anti").select(key("step:", "src").alias("source"), key("step:", "dst").alias("target"))
    edge = lambda df, kind, label="''", confidence="'resolved'": df.selectExpr("source", "target", f"'{kind}' AS kind", f"{label} AS arm_label", f"{confidence} AS confidence")
    entry = analysis.routes.select("repo", F.concat_ws("|", "repo", "handler").alias("fn_id"), F.concat_ws(" ", "method", "route_path").alias("label"))
    effects = analysis.effects.select("repo", F.concat_ws("|", "repo", "owner").alias("fn_id"), F.concat(F.lit("eff:"), F.concat_ws("|", "repo", "owner"), F.lit(":"), F.col("line").cast("string")).alias("id"), F.concat_ws(": ", F.col("kind"), F.col("target")).alias("label"), "owner")
    effects = effects.groupBy("repo", "fn_id", "id", "owner").agg(F.min("label").alias("label"))
    stitches = analysis.links.select(F.concat(F.lit("eff:"), F.concat_ws("|", "repo", "owner"), F.lit(":"), F.col("line").cast("string")).alias("source"), F.concat(F.lit("entry:"), F.concat_ws("|", "repo", "handler")).alias("target"), "confidence")
    edges = (
        edge(entry.select(key("entry:", "fn_id").alias("source"), key("step:", "fn_id").alias("target")), "sequence")
        .union(edge(plain, "sequence"))
        .union(edge(decisions.select(F.concat(F.lit("step:"), "repo", F.lit("|"), "owner").alias("source"), key("dec:", "site").alias("target")), "sequence"))
        .union(edge(arm_edges, "arm", "label"))
        .union(edge(leaving, "arm", "label"))
        .union(edge(effects.select(key("step:", "fn_id").alias("source"), F.col("id").alias("target")), "sequence"))
        .union(edge(stitches, "stitch", confidence="confidence"))
    )
    nodes = (
        entry.select(key("entry:", "fn_id").alias("id"), "repo", F.lit("entry").alias("kind"), "label", F.regexp_replace("fn_id", r"^[^|]*\|", "").alias("owner"))
        .union(fn.select(key("step:", "fn_id"), "repo", F.lit("step"), T.humanize(F.col("fn")), F.col("fn")))
        .union(decisions.join(arms.groupBy("site").agg(F.array_join(F.array_sort(F.collect_set("label")), " / ").alias("label")), "site").select(key("dec:", "site"), "repo", F.lit("decision"), T.clamp(F.col("label"), 60), "owner"))
        .union(leaving.select("target", "repo", F.lit("outcome"), F.concat_ws(" ", "terminal", "label"), F.lit(None).cast("string")))
        .union(effects.select("id", "repo", F.lit("effect"), "label", "owner"))
    )
    first = nodes.groupBy("id").agg(F.min_by(F.struct("repo", "kind", "label", "owner"), F.col("label")).alias("n")).select("id", "n.*")
    live = materialised(edges.where("source <> target").groupBy("source", "target", "kind", "arm_label").agg(F.min("confidence").alias("confidence")))
    used = live.select(F.col("source").alias("id")).union(live.select("target")).distinct()
    return Flow(materialised(first.join(used, "id", "left_semi")), live)


def levels(flow: Flow) -> DataFrame:
    """Least distance of each node from an entry, or from nodes that nothing leads to: node, level."""
    edges = flow.edges.where("kind <> 'stitch'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    roots = flow.nodes.where("kind = 'entry'").select(F.col("id").alias("node"))
    headless = flow.nodes.select(F.col("id").alias("node")).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return graph.bfs_levels(edges, roots.union(headless).distinct())


def problems(flow: Flow) -> DataFrame:
    """Rows that break a condition: rule, id.  Dangling edges, repeated ids, nodes without a way from a root, entries with a way in."""
    ids = flow.nodes.select("id")
    dangling = flow.edges.select(F.col("source").alias("id")).union(flow.edges.select("target")).join(ids, "id", "left_anti")
    repeated = flow.nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    lost = ids.join(levels(flow).select(F.col("node").alias("id")), "id", "left_anti")
    entered = flow.nodes.where("kind = 'entry'").join(flow.edges.where("kind <> 'stitch'").select(F.col("target").alias("id")), "id", "left_semi").select("id")
    return dangling.select(F.lit("dangling").alias("rule"), "id").union(repeated.select(F.lit("repeated"), "id")).union(lost.select(F.lit("unreachable"), "id")).union(entered.select(F.lit("entered"), "id"))


def forest(inner: DataFrame, found: DataFrame) -> DataFrame:
    """The parent of each node of a slice: the deepest predecessor nearer to the entry, of several the least: entry, node, parent."""
    depth = found.select("entry", F.col("node").alias("source"), F.col("distance").alias("above"))
    below = found.select("entry", F.col("node").alias("target"), F.col("distance").alias("depth"))
    near = inner.join(depth, ["entry", "source"]).join(below, ["entry", "target"]).where("above < depth")
    rank = F.row_number().over(Window.partitionBy("entry", "target").orderBy(F.desc("above"), "source"))
    return near.withColumn("rn", rank).where("rn = 1").select("entry", F.col("target").alias("node"), F.col("source").alias("parent"))


def _placed(group: pd.DataFrame) -> pd.DataFrame:
    """Columns from left to right by leaves, a parent over the middle of its children; rows by depth."""
    children: dict[str, list[str]] = {}
    for node, parent in sorted(zip(group.node, group.parent.fillna(""))):
        children.setdefault(parent, []).append(node)
    x: dict[str, float] = {}
    y: dict[str, int] = {}
    slot = 0
    stack = [(n, 0, False) for n in reversed(children.get("", []))]
    while stack:
        node, depth, done = stack.pop()
        own = children.get(node, [])
        if not own:
            x[node], slot = float(slot), slot + 1
        elif done:
            x[node] = sum(x[c] for c in own) / len(own)
        else:
            stack.append((node, depth, True))
            stack += [(c, depth + 1, False) for c in reversed(own)]
        y[node] = depth
    names = list(x)
    return pd.DataFrame({"entry": group.entry.iloc[0], "node": names, "x": [int(round(x[n] * COLUMN)) for n in names], "y": [y[n] * ROW for n in names]})


def tree_layout(tree: DataFrame, found: DataFrame) -> DataFrame:
    """Places of a slice's nodes: entry, node, x, y.  One group is one slice."""
    ship(found.sparkSession)
    rows = found.select("entry", "node").join(tree, ["entry", "node"], "left")
    return rows.groupBy("entry").applyInPandas(_placed, "entry string, node string, x long, y long")


def overlaps(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes of one slice whose boxes overlap: entry, a, b.  Boxes meet by cells of a grid."""
    width = F.create_map(*[F.lit(v) for k, (w, _) in GEOMETRY.items() for v in (k, w)])
    height = F.create_map(*[F.lit(v) for k, (_, h) in GEOMETRY.items() for v in (k, h)])
    boxes = places.join(nodes.select(F.col("id").alias("node"), "kind"), "node").withColumns({"w": F.element_at(width, F.col("kind")), "h": F.element_at(height, F.col("kind"))})
    spread = lambda c, s, n: F.explode(F.sequence(F.floor(F.col(c) / n), F.floor((F.col(c) + F.col(s) - 1) / n)))
    cells = boxes.withColumn("cx", spread("x", "w", COLUMN)).withColumn("cy", spread("y", "h", ROW))
    a, b = cells.alias("a"), cells.alias("b")
    same = (F.col("a.entry") == F.col("b.entry")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.node") < F.col("b.node"))
    over = F.expr("a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h")
    return a.join(b, same).where(over).select(F.col("a.entry").alias("entry"), F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
