"""Whole jobs: nothing is left out by an id, an edge per node, a round or a length."""

from __future__ import annotations

import random

from forkline.operators import relations


def test_subsets_of_all_owners(spark):
    r = random.Random(5)
    sets = {k: set(r.sample(range(12), r.randrange(1, 9))) for k in range(60)}
    df = spark.createDataFrame([(k, m) for k, members in sets.items() for m in members] * 2, "owner long, item long")
    wanted = {(a, b) for a in sets for b in sets if a != b and sets[a] <= sets[b]}
    assert any(a % 3 or b % 3 for a, b in wanted)
    assert {tuple(p) for p in relations.subset_join(df, "owner", "item").collect()} == wanted


def test_parts_of_every_supplier(spark, tmp_path):
    from forkline.plans.table_queries import subset_join_parts

    sets = {1: {1, 2, 3}, 2: {2, 3}, 3: {3}, 4: {1, 2, 3, 4}, 5: {9}, 7: {2, 3}}
    rows = [(s, p) for s, parts in sets.items() for p in parts]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    wanted = {(a, b) for a in sets for b in sets if a != b and sets[a] <= sets[b]}
    assert {tuple(p) for p in subset_join_parts(spark, str(tmp_path)).collect()} == wanted


def _orders(spark, folder, orders):
    rows = [(o, k, p, 1, 1.0) for o, parts in enumerate(orders) for k, p in enumerate(parts)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(folder / "lineitem.parquet"))
    return str(folder)


def test_every_succession_is_an_edge(spark, tmp_path):
    from forkline.plans import graph_queries as g

    folder = _orders(spark, tmp_path, [[1, 2, 5], [1, 3, 5], [1, 4], [4, 5], [6, 7, 8]])
    assert {tuple(e) for e in g.successions(spark, folder).collect()} == {(1, 2), (2, 5), (1, 3), (3, 5), (1, 4), (4, 5), (6, 7), (7, 8)}
    assert {tuple(r) for r in g.route_reach(spark, folder).collect()} == {(1, 0), (2, 1), (3, 1), (4, 1), (5, 2), (6, 0), (7, 1), (8, 2)}
    chain = [f"{p}/1/1" for p in (6, 7, 8)]
    assert {tuple(r) for r in g.unary_chains(spark, folder).select("head", "node", "position").collect()} == {(chain[0], node, k) for k, node in enumerate(chain)}
    assert {r.node: r.reach for r in g.closure_reach(spark, folder).collect()} == {1: 4, 2: 1, 3: 1, 4: 1, 6: 2, 7: 1}


def test_hidden_paths_choose_among(spark, tmp_path):
    from forkline.plans import graph_queries as g

    r = random.Random(8)
    orders = [[r.randrange(1, 31) for _ in range(r.randrange(2, 5))] for _ in range(35)]
    edges = {(a, b) for o in orders for a, b in zip(o, o[1:]) if a != b}
    wanted, frontier = {}, {(a, b): str(b) for a, b in edges if a % 10 == 0 and b % 10}
    for hops in range(1, g.DEPTH + 1):  # every walk over hidden nodes, kept by its least text
        for (a, at), path in frontier.items():
            for b in (y for x, y in edges if x == at and y % 10 == 0 and y != a and (a, y) not in edges):
                wanted[a, b] = min(wanted.get((a, b), (hops, path)), (hops, path))
        ahead = [((a, y), f"{path},{y}") for (a, at), path in frontier.items() for x, y in edges if x == at and y % 10]
        frontier = {}
        for key, path in ahead:
            frontier[key] = min(frontier.get(key, path), path)
    assert len(wanted) > 2
    found = {(x.src, x.dst): (x.hops, x.path) for x in g.hidden_path_best(spark, _orders(spark, tmp_path, orders)).collect()}
    assert found == wanted


def plain_hits(edges, rounds):
    nodes = {n for a, b, _ in edges for n in (a, b)}
    hub = dict.fromkeys(nodes, 1.0)
    for _ in range(rounds):
        authority = {n: sum(w * hub[a] for a, b, w in edges if b == n) for n in nodes}
        raw = {n: sum(w * authority[b] for a, b, w in edges if a == n) for n in nodes}
        hub, authority = ({n: x / sum(v.values()) for n, x in v.items()} for v in (raw, authority))
    return {n: (hub[n], authority[n]) for n in nodes}


def test_hits_run_to_the_reference_rounds(spark, tmp_path):
    from forkline.plans.graph_queries import hits_supplier_part

    pairs = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), (4, 4), (4, 5), (5, 5), (5, 6), (5, 7)]
    spark.createDataFrame(pairs, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = [(f"s{a}", f"p{b}", 1) for a, b in pairs]
    wanted, few = plain_hits(edges, 50), plain_hits(edges, 3)
    found = {r.node: (r.hub, r.authority) for r in hits_supplier_part(spark, str(tmp_path)).collect()}
    assert found.keys() == wanted.keys()
    assert all(abs(x - y) < 2e-6 for n in wanted for x, y in zip(found[n], wanted[n]))
    assert any(abs(few[n][0] - wanted[n][0]) > 1e-3 for n in wanted)


def test_flagship_and_pillars_use_all_rounds(spark, monkeypatch):
    from forkline.operators import graph
    from forkline.plans import graph_queries
    from forkline.plans.analysis import Analysis
    from forkline.plans.sample import sources

    seen, hits = [], graph.hits
    monkeypatch.setattr(graph, "hits", lambda edges, iterations=50: seen.append(iterations) or hits(edges, 1))
    assert Analysis(sources(spark)).pillars.count() > 0
    graph_queries.flagship(spark, "/root/testdata/sf0.001")
    assert seen == [50, 50]


def test_calls_longer_than_a_label(spark):
    from forkline.plans.analysis import Analysis

    long = ", ".join(f"column_{k:03d}" for k in range(40))
    url = "http://stock/" + "deep/" * 40 + "items"
    files = {
        "shop/api.py": "from fastapi import APIRouter\nrouter = APIRouter()\n\n@router.get('/items')\ndef items():\n    return 1\n",
        "shop/main.py": f"from fastapi import FastAPI\nfrom shop.api import router\napp = FastAPI()\napp.include_router(router, tags=[{', '.join(repr(c) for c in long.split(', '))}], prefix='/stock')\n",
        "shop/work.py": f"import sqlite3\nimport requests\n\ndef load():\n    sqlite3.execute('SELECT {long} FROM orders')\n\ndef ask():\n    requests.get('{url}')\n    requests.get(\"http://stock/it's\")\n",
    }
    a = Analysis(spark.createDataFrame([("r", p, c) for p, c in files.items()], "repo string, path string, content string"))
    assert [(r.handler, r.route_path) for r in a.routes.collect()] == [("shop.api.items", "/stock/items")]
    assert {(r.kind, r.target) for r in a.effects.collect()} == {("db", "orders"), ("http_out", url), ("http_out", "http://stock/it's")}


def test_nested_calls_with_one_label_have_two_keys(spark):
    from forkline.plans.analysis import Analysis

    code = f"import requests\n\ndef f():\n    requests.get('{'x' * 130}')('a')('b')\n"
    a = Analysis(spark.createDataFrame([("r", "m.py", code)], "repo string, path string, content string"))
    keys = [r.call for r in a.calls.where("caller = 'm.f'").collect()]
    assert len(keys) == len(set(keys)) == 3
