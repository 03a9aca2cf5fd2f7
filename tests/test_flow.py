"""Slices, budgets, hosts and layout on made-up graphs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from forkline.operators import flow, slicing


@pytest.fixture(scope="module")
def graphs(spark):
    """Three entries over one random graph of steps, cycles included."""
    r = random.Random(7)
    pairs = {(f"e{k}", f"n{r.randrange(40):02d}") for k in range(3) for _ in range(3)} | {(f"n{r.randrange(40):02d}", f"n{r.randrange(40):02d}") for _ in range(70)}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    edges = spark.createDataFrame([(a, b, "sequence", "", "resolved") for a, b in pairs], "source string, target string, kind string, arm_label string, confidence string")
    ids = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(i, "r", "entry" if i[0] == "e" else "step", i, f"own{int(i[1:]) % 4}") for i in ids], "id string, repo string, kind string, label string, owner string")
    return pairs, flow.Flow(nodes, edges)


def reached(pairs, root):
    found, level, d = {root: 0}, [root], 0
    while level:
        d += 1
        level = sorted({b for a, b in pairs if a in level and b not in found})
        found |= {b: d for b in level}
    return found


def test_members_are_what_is_reached(graphs):
    pairs, g = graphs
    found = slicing.members(g.edges, g.nodes.where("kind = 'entry'").select(F.col("id").alias("entry")))
    assert {(r.entry, r.node, r.distance) for r in found.collect()} == {(e, n, d) for e in ("e0", "e1", "e2") for n, d in reached(pairs, e).items()}


def test_budget_hosts_and_layout(graphs):
    pairs, g = graphs
    found = slicing.members(g.edges, g.nodes.where("kind = 'entry'").select(F.col("id").alias("entry"))).cache()
    kept = slicing.chosen(found, g.edges, g.nodes, 7).cache()
    for entry in ("e0", "e1", "e2"):
        members = reached(pairs, entry)
        own = [r.node for r in kept.where(F.col("entry") == entry).orderBy("place").collect()]
        assert len(own) == min(7, len(members)) and own[0] == entry
        assert all(any((p, n) in pairs for p in own[:k]) for k, n in enumerate(own) if k)
    hosts = slicing.hosted(found, g.edges, kept).collect()
    shown = {(r.entry, r.node) for r in kept.collect()}
    assert {(r.entry, r.node) for r in hosts} == {(r.entry, r.node) for r in found.collect()} - shown
    assert all((r.entry, r.host) in shown for r in hosts)
    inner = slicing.acyclic(slicing.inner_edges(g.edges, found))
    for entry in ("e0", "e1", "e2"):
        own = [(r.source, r.target) for r in inner.where(F.col("entry") == entry).collect()]
        order, left = [], set(reached(pairs, entry))
        while left:
            free = [n for n in left if not any(b == n and a in left for a, b in own)]
            assert free, "a cycle is left"
            order += free
            left -= set(free)
    places = flow.tree_layout(flow.forest(inner, found), found)
    assert places.count() == found.count()
    assert flow.overlaps(places, g.nodes).count() == 0


def test_outer_targets_and_closing(spark, graphs):
    pairs, g = graphs
    found = spark.createDataFrame([("e0", "e0", 0), *(("e0", b, 1) for a, b in pairs if a == "e0")], "entry string, node string, distance int")
    own = {r.node for r in found.collect()}
    outside = slicing.outer_targets(g.edges, found)
    assert {(r.source, r.target) for r in outside.collect()} == {(a, b) for a, b in pairs if a in own and b not in own}
    leaves = {a for a in own if not any(x == a and y in own for x, y in pairs)}
    wanted = {(f"endlink:{a}:{k}", a, t) for a in leaves for k, t in enumerate(sorted(b for x, b in pairs if x == a and b not in own)[:2])}
    assert {(r.node, r.source, r.target) for r in slicing.closing(found, g.edges, outside).collect()} == wanted


def test_problems_are_found(spark, graphs):
    pairs, g = graphs
    ids = {x for p in pairs for x in p}
    seen = {i for i in ids if i[0] == "e"} | (ids - {b for _, b in pairs})
    while more := {b for a, b in pairs if a in seen} - seen:
        seen |= more
    stranded = {("unreachable", i) for i in ids - seen}  # cycles that no root leads to
    assert stranded and {(r.rule, r.id) for r in flow.problems(g).collect()} == stranded
    bad = flow.Flow(g.nodes.union(g.nodes.where("id = 'e0'")), g.edges.union(g.edges.limit(1).withColumn("target", F.lit("nowhere"))))
    assert {(r.rule, r.id) for r in flow.problems(bad).collect()} == stranded | {("dangling", "nowhere"), ("repeated", "e0")}
