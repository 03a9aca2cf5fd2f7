"""Function summaries and region projection against a recursive walk over random programs."""

from __future__ import annotations

import random

import pytest

from forkline.operators import graph
from forkline.operators.summaries import PRIORITY, Program, projected


def reach(edges):
    out = {a: {b for x, b in edges if x == a} for a, _ in edges}
    while True:
        more = {a: bs | {c for b in bs for c in out.get(b, ())} for a, bs in out.items()}
        if more == out:
            return out
        out = more


class Walk:
    """One function after the other, memoised, as the definition says."""

    def __init__(self, functions, items, arms, lines):
        self.functions, self.items, self.arms, self.lines = functions, sorted(set(items), key=lambda i: (i[2], PRIORITY[i[3]], i[4])), arms, lines
        site = {i[4]: i[0] for i in items if i[3] == "parallel"}
        calls = {(f, c) for f, _, _, k, c in items if k == "call" and c in functions} | {(site[s], c) for s, c in lines if s in site and c in functions}
        far = reach(calls)
        self.inner = {(a, b) for a, b in calls if a == b or a in far.get(b, ())}
        self.memo, self.edges = {}, {}

    def connect(self, src, dst, kind, arm=""):
        if src != dst:
            self.edges[src, dst, arm] = min(kind, self.edges.get((src, dst, arm), kind))

    def summary(self, fn):
        if fn not in self.memo:
            self.memo[fn] = self.region(fn, "")
        return self.memo[fn]

    def region(self, fn, region):
        head, frontier, waiting = None, [], None

        def link(node):
            nonlocal head
            head = head or node
            for src in frontier:
                self.connect(src, node, "sequence")

        for f, r, line, kind, ident in self.items:
            if (f, r) != (fn, region) or kind == "call" and ident not in self.functions:
                continue
            callee = (None, []) if kind != "call" or (fn, ident) in self.inner else self.summary(ident)
            if kind == "call" and callee[0] is None:
                waiting = line if waiting is None else waiting
                continue
            if waiting is not None:
                link(f"step:{fn}:{waiting}")
                frontier, waiting = [f"step:{fn}:{waiting}"], None
            node = callee[0] if kind == "call" else f"dec:{ident}" if kind == "decision" else ident
            link(node)
            if kind == "call":
                frontier = callee[1]
            elif kind == "effect":
                frontier = [node]
            elif kind == "parallel":
                into = [self.summary(c) for s, c in self.lines if s == ident and c in self.functions and (fn, c) not in self.inner]
                for h, _ in into:
                    if h:
                        self.connect(node, h, "parallel")
                frontier = [t for h, ts in into if h for t in ts] or [node]
            else:
                ends = []
                for s, arm, terminal in self.arms:
                    if s == ident:
                        h, ts = self.region(fn, f"{s}#{arm}")
                        if h:
                            self.connect(node, h, "arm", f"{s}#{arm}")
                            ends += ts
                        elif terminal == "falls_through":
                            ends.append(node)
                        else:
                            self.connect(node, f"out:{s}:{arm}", "arm", f"{s}#{arm}")
                frontier = ends or [node]
        return head, sorted(set(frontier)) if head else []


def program(seed):
    r = random.Random(seed)
    functions = [f"f{k}" for k in range(25)]
    items, arms, lines, sites = [], [], [], 0

    def fill(fn, region, depth):
        nonlocal sites
        for _ in range(r.randrange(0, 5 if depth else 6)):
            kind = r.choice(["call", "call", "call", "effect", "decision", "parallel"]) if depth < 2 else "call"
            line = r.randrange(1, 9)
            if kind == "call":
                items.append((fn, region, line, kind, r.choice([*functions[int(fn[1:]) + 1 :], r.choice(functions), "nowhere"])))
            elif kind == "effect":
                items.append((fn, region, line, kind, f"e{r.randrange(8)}"))
            else:
                sites += 1
                site = f"s{sites}"
                items.append((fn, region, line, kind, site))
                for k in range(r.randrange(0, 4)):
                    if kind == "parallel":
                        lines.append((site, r.choice([*functions, "nowhere"])))
                    else:
                        arms.append((site, k, r.choice(["falls_through", "return"])))
                        fill(fn, f"{site}#{k}", depth + 1)

    for fn in functions:
        if r.random() < 0.85:
            fill(fn, "", 0)
    return functions, items, arms, lines


def frames(spark, functions, items, arms, lines):
    return Program(
        spark.createDataFrame([(f,) for f in functions], "fn string"), spark.createDataFrame(items * 2, "fn string, region string, line long, kind string, id string"),
        spark.createDataFrame(arms, "site string, arm int, terminal string"), spark.createDataFrame(lines, "site string, callee string"),
    )


@pytest.mark.parametrize("seed", range(4))
def test_projection(spark, seed):
    given = program(seed)
    walk = Walk(*given)
    found = projected(frames(spark, *given))
    calls = {i[:1] + i[4:] for i in given[1] if i[3] == "call"}
    wanted = {f: (walk.summary(f)[0], len(walk.summary(f)[1]), any((f, c) in walk.inner for x, c in calls if x == f)) for f in given[0]}
    assert {r.fn: (r.head, r.n_tails, r.recursive) for r in found.summaries.collect()} == wanted
    tails = {}
    for r in found.tails.collect():
        tails.setdefault(r.fn, []).append(r.node)
    assert {f: sorted(ts) for f, ts in tails.items()} == {f: walk.summary(f)[1] for f in given[0] if walk.summary(f)[1]}
    assert {(r.src, r.dst, r.arm): r.kind for r in found.edges.collect()} == {(a, b, arm): kind for (a, b, arm), kind in walk.edges.items()}
    into = {(f, region, c) for f, region, _, k, c in given[1] if k == "call" and c in given[0] and (f, c) not in walk.inner and walk.summary(c)[0]}
    assert {tuple(r) for r in found.boundaries.collect()} == into


def test_empty_program(spark):
    empty = projected(frames(spark, [], [], [], []))
    assert empty.summaries.count() == empty.edges.count() == empty.tails.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_depths_and_bridges(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range((25, 45, 60)[seed])] + [(50, 51), (51, 52), (52, 50), (52, 53), (60, 60), (53, 61), (61, 60)]
    df = spark.createDataFrame(edges * 2, "src long, dst long")
    far = reach(edges)
    nodes = {x for e in edges for x in e}
    same = {x: {y for y in far.get(x, ()) if x in far.get(y, ())} | {x} for x in nodes}
    assert {x.node: x.component for x in graph.strong_components(df).collect()} == {x: min(ys) for x, ys in same.items() if len(ys) > 1}
    assert {x.node: x.reach for x in graph.reach_sizes(df).collect()} == {x: len(ys) for x, ys in far.items() if ys}
    assert {x.node: x.reach for x in graph.reach_sizes(df, itself=False).collect()} == {x: len(ys - {x}) for x, ys in far.items() if ys}
    depth, count = dict.fromkeys(nodes, 0), {x: len({a for a, b in edges if b == x}) for x in nodes}
    queue, done = [x for x in nodes if not count[x]], set()
    for x in queue:
        done.add(x)
        for y in {b for a, b in edges if a == x}:
            depth[y] = max(depth[y], depth[x] + 1)
            count[y] -= 1
            queue += [y] * (count[y] == 0)
    wanted = {x: depth[x] if x in done else max(depth.values()) for x in nodes}
    assert {x.node: x.depth for x in graph.longest_depth(df).collect()} == wanted
    left = set(edges)
    dropped = sorted(x for x in nodes if x % 3 == 0)
    for x in dropped:  # one after the other
        into, out = {a for a, b in left if b == x and a != x}, {b for a, b in left if a == x and b != x}
        left = {e for e in left if x not in e} | {(a, b) for a in into for b in out}
    gone = spark.createDataFrame([(x,) for x in dropped * 2], "node long")
    assert {tuple(x) for x in graph.bridged(df, gone).collect()} == {e for e in left if e[0] != e[1]}


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.strong_components(none).count() == graph.longest_depth(none).count() == graph.reach_sizes(none).count() == 0
    assert graph.bridged(none, none.selectExpr("src AS node")).count() == 0
