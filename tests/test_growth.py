"""Work that has to grow with the input and no faster: what the steps are given is counted."""

from __future__ import annotations

import random
import re

import pytest

from forkline.operators import bodies, condensing, containment, folding, graph, modules, slicing, summaries
from forkline.plans import graph_queries
from forkline.session import dealt, materialised
from tests.conftest import SF
from tests.test_whole import plain_hits


def test_methods_of_a_class_are_listed_once(spark, monkeypatch):
    given, top_k = [], modules.top_k

    def counted(rows, *rest, **more):
        given.append(rows.count())
        return top_k(rows, *rest, **more)

    monkeypatch.setattr(modules, "top_k", counted)
    n = 300
    functions = spark.createDataFrame([(f"f{k:03}", "c") for k in range(n)] + [("g", None)], "fqn string, cls string")
    calls = spark.createDataFrame([(f"f{k:03}", "g") for k in range(n)] + [("g", "f000"), ("g", "g")], "caller string, callee string")
    found = modules.key_methods(functions.select(functions.fqn.alias("handler")), functions, calls, 4).collect()
    wanted = {(f"f{k:03}", fqn, rank) for k in range(n) for rank, fqn in enumerate(("c", "f000", "f001", "f002"), 1)}
    assert {tuple(r) for r in found} == wanted | {("g", "g", 1), ("g", "f000", 2)}
    assert sum(given) < 8 * n  # not n times n


@pytest.mark.parametrize("odd", [None, "cast(null as long)", "-1L", "8000000000000000000L"])
def test_shipments_are_numbers_where_these_hold_them(spark, tmp_path, odd):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey < 300")
    if odd is not None:
        lines = lines.selectExpr("* except (l_suppkey)", f"if(l_linenumber = 2, {odd}, l_suppkey) as l_suppkey")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    edges, name = graph_queries.shipments(spark, str(tmp_path))
    assert (edges.schema["src"].dataType.typeName() == "long") == (odd is None)
    rows = lines.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "concat_ws('/', l_partkey, l_suppkey, cast(l_quantity as long)) as name").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect()
    wanted = {(a.name, b.name) for a, b in zip(rows, rows[1:]) if a.l_orderkey == b.l_orderkey and a.name != b.name}
    assert {tuple(r) for r in edges.select(name("src"), name("dst")).collect()} == wanted


def test_nodes_whose_head_is_known_leave_the_runs(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialised", lambda df, f=graph.materialised: (written.append(df), f(df))[1])
    short = [(10 * k + p, 10 * k + p + 1) for k in range(50) for p in range(2)]
    ring = [(-1, -2), (-2, -3), (-3, -1)]
    long_ = [(k, k + 1) for k in range(1000, 1040)]
    found = graph.unary_chains(spark.createDataFrame(short + ring + long_, "src long, dst long"))
    assert {tuple(r) for r in found.collect()} == {(10 * k, 10 * k + p, p, 3) for k in range(50) for p in range(3)} | {(1000, 1000 + p, p, 41) for p in range(41)}
    sizes = [df.count() for df in written]
    assert sizes[0] == 143 and sizes[3] < 45 and len(sizes) < 10  # links; the long run and the ring; rings do not go round for ever


def test_depths_move_waiting_nodes_alone(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialised", lambda df, f=graph.materialised: (written.append(df), f(df))[1])
    pairs = [(2 * k, 2 * k + 1) for k in range(100)] + [(k, k + 1) for k in range(1000, 1005)] + [(5000, 5000), (1005, 5000)]
    found = {r.node: r.depth for r in graph.longest_depth(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert found == {k: k % 2 for k in range(200)} | {1000 + p: p for p in range(6)} | {5000: 6}
    assert sum(df.count() for df in written) < 207 + 106 + 30


def test_closing_by_turns_looks_up_no_known_pair(spark, monkeypatch):
    monkeypatch.setattr(graph, "transitive_closure", None)
    pairs = {(k, d) for k in range(1, 40) for d in (2 * k, 2 * k + 1, 3 * k) if d < 80} | {(100, 101), (101, 100), (79, 100), (101, 102), (103, 103)}
    far = {a: {d for s, d in pairs if s == a} for a in range(1, 104)}
    for _ in range(80):
        far = {a: ds | {x for d in ds for x in far[d]} for a, ds in far.items()}
    df = spark.createDataFrame(sorted(pairs), "src long, dst long")
    assert {r.node: r.reach for r in graph.reach_sizes(df).collect()} == {a: len(ds) for a, ds in far.items() if ds}
    assert {r.node: r.reach for r in graph.reach_sizes(df, itself=False).collect() if r.reach} == {a: len(ds - {a}) for a, ds in far.items() if ds - {a}}


def test_bodies_are_ordered_in_batches(spark):
    contained = spark.createDataFrame([(k, k // 4) for k in range(4, 400)] + [(1, None)], "node long, container long")
    edges = spark.createDataFrame([(4 * k + 3, 4 * k) for k in range(1, 100)] + [(9, 10), (10, 9)], "src long, dst long")
    found = bodies.body_order(contained, edges, contained.selectExpr("node", "cast(null as string) as file", "cast(null as long) as line"))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()  # a frame for each body
    wanted = {(k, 4 * k + m, place) for k in range(1, 100) for place, m in enumerate((1, 2, 3, 0))} - {(2, 8 + m, p) for p, m in enumerate((1, 2, 3, 0))}
    assert {tuple(r) for r in found.collect()} == wanted | {(2, 11, 0), (2, 8, 1), (2, 9, 2), (2, 10, 3)}


def test_tasks_grow_in_number_with_the_rows(spark):
    rows = spark.range(1000).selectExpr("id % 100 as key", "id")
    assert dealt(rows, "key", 10).rdd.getNumPartitions() == 100
    assert dealt(rows, "key").rdd.getNumPartitions() == 4


def test_arms_are_counted_where_their_sites_lie(spark):
    rows = [(1, "a", 5, 5), (1, "a", 5, 6), (1, "a", 5, 6), (1, "a", 5, 7), (1, "b", 5, 9), (2, "a", 5, None), (2, None, 5, 8), (3, "a", None, 8)]
    arms = dealt(spark.createDataFrame(rows, "site long, idx string, owner long, component long"), "site")
    found = containment.arm_reach(arms, materialised(spark.createDataFrame([(9,), (None,), (9,)], "component long")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(site") == 1  # arms move once
    assert {tuple(r) for r in found.collect()} == {(1, "a", 2), (1, "b", 0), (2, "a", 0), (2, None, 1), (3, "a", 0)}


@pytest.mark.parametrize("name", ["sole_children", "run_hosts"])
def test_slices_do_not_pass_through_the_driver(spark, monkeypatch, name):
    plans = []
    for module in (slicing, folding, graph):
        monkeypatch.setattr(module, "materialised", lambda df, f=module.materialised: (plans.append(df), f(df))[1])
    parts = spark.range(1, 61).selectExpr("id as node", "id % 3 as entry")
    edges = parts.selectExpr("entry", "node as source", "node + 3 as target", "'sequence' as kind").where("target <= 60")
    if name == "run_hosts":
        plans.append(folding.run_hosts(parts.selectExpr("entry", "node", "node <= 3 as root"), edges, parts.where("node % 30 = 0").select("entry", "node"), floor=1))
    else:
        plans.append(folding.sole_children(parts.selectExpr("node % 3 as entry", "node"), edges.drop("entry"), parts.where("node % 4 <> 0").select("entry", "node")))
    assert plans[-1].count() > 0
    large = [p for df in plans for p in df._jdf.queryExecution().executedPlan().toString().split("\n") if re.search(r"BroadcastHashJoin \[(?!entry#\d+L?\])", p) and "key" not in p]
    assert len(plans) > 3 and not large  # slices' sizes and roots are a row each


def test_who_leads_to_a_place_is_looked_for_among_the_rest(spark, monkeypatch):
    written = []
    monkeypatch.setattr(summaries, "materialised", lambda df, f=summaries.materialised: (written.append(df), f(df))[1])
    pairs = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000), (2000, 2001)]
    start = list(range(198)) + [1000]
    found = summaries.led_to(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(k,) for k in start], "node long"))
    assert sorted(r.node for r in found.collect()) == sorted({*range(201), 1000, 1001, 1002})
    assert sum(df.count() for df in written[1:]) < 30  # edges to what is known by the start are gone


def test_what_nothing_lies_in_is_not_walked(spark, monkeypatch):
    """Of 300 leaves in a chain of five none is written with the containers that requests are tried against."""
    written = []
    monkeypatch.setattr(condensing, "materialised", lambda df, f=condensing.materialised: (written.append(df), f(df))[1])
    edges = [(f"leaf{k}", f"n{k % 5}") for k in range(300)] + [(f"n{k}", f"n{k + 1}") for k in range(4)]
    asked = [("n4", "n0", "a"), ("n4", "x", "b"), ("n2", "leaf7", "c"), ("y", "n1", "d")]
    found = condensing.safely_placed(spark.createDataFrame(edges, "node string, container string"), spark.createDataFrame(asked, "node string, start string, key string"))
    assert {tuple(r) for r in found.collect()} == {("n4", "x"), ("y", "n1")}  # all above leaf7 lies in n2 or is it
    assert max(df.count() for df in written) < 30


@pytest.mark.parametrize("whole", [graph.__dict__.get("WHOLE"), 5, 0])
def test_hits_of_a_component_are_one_job(spark, monkeypatch, whole):
    written = []
    monkeypatch.setattr(graph, "WHOLE", whole, raising=False)
    monkeypatch.setattr(graph, "materialised", lambda df, f=graph.materialised: (written.append(df), f(df))[1])
    edges = [(f"s{a}", f"p{b}", w) for a, b, w in [(1, 1, 2), (1, 2, 1), (2, 2, 1), (2, 3, 4), (3, 3, 1), (3, 1, 3), (4, 4, 5), (4, 5, 2), (5, 5, 6), (6, 6, 9)]] + [("x", "y", 3), ("y", "z", 1), ("z", "z", 0)]
    odd = [("null", None, 1.0), ("none", "p1", None)]
    found = {r.node: (r.hub, r.authority) for r in graph.hits(spark.createDataFrame([(a, b, float(w)) for a, b, w in edges] + odd, "src string, dst string, weight double"), 12).collect()}
    wanted = plain_hits(edges, 12) | {"null": (0, 0), "none": (0, 0), None: (0, 0)}
    assert found.keys() == wanted.keys() and all(abs(x - y) < 2e-6 for n in wanted for x, y in zip(found[n], wanted[n]))
    if whole and whole > 5:
        assert len(written) < 12  # tables of the labels; none of a round


@pytest.mark.parametrize("whole", [graph.__dict__.get("WHOLE"), 40, 0])
def test_what_walks_meet_is_not_written(spark, monkeypatch, whole):
    written, r = [], random.Random(11)
    monkeypatch.setattr(graph, "WHOLE", whole, raising=False)
    monkeypatch.setattr(graph, "WALKS", 2, raising=False)
    monkeypatch.setattr(graph, "materialised", lambda df, f=graph.materialised: (written.append(df), f(df))[1])
    pairs = {(r.randrange(60), r.randrange(60)) for _ in range(240)} | {(100 + r.randrange(20), 100 + r.randrange(20)) for _ in range(35)}
    names = {n: f"a{'!b' if n == 7 and whole == 40 else ''}{n}" for p in pairs for n in p}  # "!" comes before the comma
    shown = {n for n in names if n % 5 == 0}
    wanted = {}
    for source in shown:
        layer = {b: names[b] for a, b in pairs if a == source and b not in shown}
        for hops in range(1, 5):
            for at, path in layer.items():
                for end in (b for a, b in pairs if a == at and b in shown and b != source and (source, b) not in pairs):
                    wanted[source, end] = min(wanted.get((source, end), (hops, path)), (hops, path))
            ahead = {}
            for at, path in layer.items():
                for b in (b for a, b in pairs if a == at and b not in shown):
                    ahead[b] = min(ahead.get(b, f"{path},{names[b]}"), f"{path},{names[b]}")
            layer = ahead
    edges = spark.createDataFrame([(names[a], names[b]) for a, b in sorted(pairs)], "src string, dst string")
    found = graph.hidden_paths(edges, spark.createDataFrame([(names[n],) for n in shown], "node string"), 4).collect()
    assert len(found) == len(wanted) > 60 and {(x.src, x.dst): (x.hops, x.path) for x in found} == {(names[a], names[b]): v for (a, b), v in wanted.items()}
    if whole and whole > 40:
        assert not [df for df in written if "path" in df.columns]


@pytest.mark.parametrize("rest", [graph.__dict__.get("REST"), 60, 0])
def test_a_small_rest_of_a_graph_costs_no_rounds(spark, monkeypatch, rest):
    written, r = [], random.Random(12)
    monkeypatch.setattr(graph, "REST", rest, raising=False)
    monkeypatch.setattr(graph, "materialised", lambda df, f=graph.materialised: (written.append(df), f(df))[1])
    pairs = {(r.randrange(40), r.randrange(40)) for _ in range(55)} | {(k, k + 1) for k in range(100, 130)} | {(200, 201), (201, 200), (201, 202)}
    far = {a: {b for s, b in pairs if s == a} for p in pairs for a in p}
    for _ in range(7):
        far = {a: bs | {c for b in bs for c in far[b]} for a, bs in far.items()}
    same = {a: {b for b in bs if a in far[b]} | {a} for a, bs in far.items()}
    found = {x.node: x.component for x in graph.strong_components(spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()}
    assert found == {a: min(bs) for a, bs in same.items() if len(bs) > 1} and len(found) > 4
    if rest and rest > 60:
        assert len(written) == 1
