"""Operators against plain Python on random and hand-made inputs."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from forkline.functions import text as T
from forkline.operators import graph, ranking, relations
from forkline.sources.facts import facts
from forkline.sources.trees import is_source, is_test_path, read_archives, read_tree, without_nested_repos


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def reach(pairs):
    step = defaultdict(set)
    for a, b in pairs:
        step[a].add(b)
    out = set()
    for a in list(step):
        todo, seen = list(step[a]), set()
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += step[b]
        out |= {(a, b) for b in seen}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_closures_agree(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(25), r.randrange(25)) for _ in range(35)]
    wanted = reach(pairs)
    assert {tuple(x) for x in graph.transitive_closure(edges_of(spark, pairs)).collect()} == wanted
    assert {tuple(x) for x in graph.doubled_closure(edges_of(spark, pairs)).collect()} == wanted


def test_components_of_a_chain_and_a_cycle(spark):
    pairs = [(k, k + 1) for k in range(1, 30)] + [(50, 51), (51, 52), (52, 50)]
    found = {r.node: r.component for r in graph.connected_components(edges_of(spark, pairs)).collect()}
    assert found == {k: 1 for k in range(1, 31)} | {50: 50, 51: 50, 52: 50}


def test_longest_depth_of_long_paths_and_cycles(spark):
    found = {r.node: r.depth for r in graph.longest_depth(edges_of(spark, [(k, k + 1) for k in range(25)] + [(30, 31), (31, 30), (25, 30)])).collect()}
    assert found == {k: k for k in range(26)} | {30: 26, 31: 26}


def test_empty_graphs(spark):
    none = edges_of(spark, [])
    assert graph.transitive_closure(none).count() == 0
    assert graph.connected_components(none).count() == 0
    assert graph.unary_chains(none).count() == 0
    assert graph.hits(none.withColumn("weight", F.lit(1)), 2).count() == 0


def test_hidden_paths_prefer_short_then_text(spark):
    pairs = [(1, 10), (10, 2), (1, 11), (11, 2), (1, 12), (12, 13), (13, 3), (2, 3), (1, 4)]
    visible = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "node long")
    found = {(r.src, r.dst): (r.hops, r.path) for r in graph.hidden_paths(edges_of(spark, pairs), visible).collect()}
    assert found == {(1, 2): (1, "10"), (1, 3): (2, "12,13")}


@pytest.mark.parametrize("seed", range(3))
def test_fair_demotion_is_the_greedy(spark, seed):
    r = random.Random(seed)
    rows = [(f"l{r.randrange(4)}", float(r.randrange(6)), k) for k in range(30)]
    excess = 11
    lanes = defaultdict(list)
    for lane, strength, node in rows:
        lanes[lane].append((-strength, node))
    gone = set()
    for members in lanes.values():
        members.sort()
    for _ in range(excess):
        lane = max(lanes, key=lambda x: (len(lanes[x]), x))
        gone.add(lanes[lane].pop()[1])
    df = spark.createDataFrame(rows, "lane string, strength double, node long")
    assert {x.node for x in ranking.fair_demotion(df, "lane", "strength", "node", excess).collect()} == gone


def test_apportion_without_mass(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "lane string, mass long")
    assert {r.budget for r in ranking.apportion(df, "lane", "mass").collect()} == {13}


def test_route_match_tiers(spark):
    calls = spark.createDataFrame([("full", "GET", ["a", "7"]), ("suffix", "GET", ["v1", "b", "8"]), ("two", "GET", ["c", "x"]), ("verb", "POST", ["a", "7"])], "call_id string, method string, segments array<string>")
    routes = spark.createDataFrame([("r1", "GET", ["a", "{id}"]), ("r2", "GET", ["b", "{id}"]), ("r3", "GET", ["c", "x"]), ("r4", "GET", ["c", "{y}"])], "route string, method string, segments array<string>")
    found = {(r.call_id, r.route, r.confidence) for r in relations.route_match(calls, routes).collect()}
    assert found == {("full", "r1", "resolved"), ("suffix", "r2", "inferred")}


def test_site_verdicts(spark):
    rows = [
        ("one", "branch", 0, "falls_through", ["a", "b", "c"]), ("one", "branch", 1, "falls_through", ["d"]),
        ("sub", "branch", 0, "falls_through", ["a", "b"]), ("sub", "branch", 1, "falls_through", ["a"]),
        ("guard", "branch", 0, "raises", []), ("guard", "branch", 1, "falls_through", ["a"]),
        ("route", "route", 0, "returns", []), ("route", "route", 1, "returns", []),
        ("void", "match", 0, "falls_through", []), ("void", "match", 1, "falls_through", []),
    ]
    df = spark.createDataFrame(rows, "site string, kind string, idx int, terminal string, reach array<string>")
    found = {r.site: r.verdict for r in ranking.site_verdicts(df).collect()}
    assert found == {"one": "decision", "sub": "noise", "guard": "guarded_step", "route": "decision", "void": "noise"}


def test_scalar_functions(spark):
    row = spark.range(1).select(
        T.normalize_out_path(F.lit("/a//b?x=1")).alias("rooted"), T.normalize_out_path(F.lit("http://a/b")).alias("absolute"), T.path_params(F.lit("/x/{a}/<int:b>/{a:int}")).alias("params"),
        T.humanize(F.lit("shop.OrderService_v2")).alias("label"), T.http_status(F.lit("HttpResponseNotFound()")).alias("status"), T.step_label(F.lit("self.repo.load_all(x, y)")).alias("step"),
        T.noise_rule(F.lit("logger.info")).alias("noise"), T.catalog_label(F.lit("Orders · 3 routes")).alias("catalog"), T.package_of(F.lit("a/b/c.py")).alias("package"), T.fingerprint(F.lit(None).cast("string"), F.lit("x")).alias("fp"),
    ).first()
    assert row.rooted == ["a", "b"] and row.absolute is None and row.params == ["a", "b"] and row.label == "Order Service V2"
    assert (row.status, row.step, row.noise, row.catalog, row.package, len(row.fp)) == ("404", "load all", "logging", "Orders", "a.b", 64)


def test_path_filters(spark):
    paths = ["a/b.py", "a/__init__.py", "tests/x.py", "a/test_x.py", "c.txt", "a/venv/z.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p for r in df.where(is_source(F.col("p"))).collect()} == {"a/b.py", "a/test_x.py"}
    assert {r.p for r in df.where(is_test_path(F.col("p"))).collect()} == {"tests/x.py", "a/test_x.py"}


def test_nested_repositories(spark):
    df = spark.createDataFrame([("r", p) for p in ("a/x.py", "lib/.git/config", "lib/y.py", "lib/deep/z.py", ".git/config", "libb/w.py")], "repo string, path string")
    assert {r.path for r in without_nested_repos(df).collect()} == {"a/x.py", ".git/config", "libb/w.py"}


def test_tree_and_archive(spark, tmp_path):
    import io
    import tarfile

    (tmp_path / "src/tests").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/tests/t.py").write_text("x = 2\n")
    assert [tuple(r) for r in read_tree(spark, str(tmp_path), "r").collect()] == [("r", "src/a.py", "x = 1\n")]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in (("ok.py", b"y"), ("../out.py", b"n"), ("/abs.py", b"n")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    df = spark.createDataFrame([("r", bytearray(out.getvalue()))], "repo string, data binary")
    assert [tuple(r)[:3] for r in read_archives(df).collect()] == [("r", "ok.py", "y")]
    assert {tuple(r) for r in read_archives(df, most=0).collect()} == {("r", "ok.py", None, "too large: 1")}
    bad = spark.createDataFrame([("b", b"no archive"), ("n", None)], "repo string, data binary")
    assert {(r.repo, r.path, r.content, r.problem[:7]) for r in read_archives(bad).collect()} == {("b", None, None, "damaged"), ("n", None, None, "damaged")}
    assert facts(read_archives(bad)).count() == 0


def test_odd_files_give_one_row_each(spark, tmp_path):
    (tmp_path / "latin.py").write_bytes("x = 'é'\n".encode("latin-1"))
    assert [r.content for r in read_tree(spark, str(tmp_path), "r").collect()] == ["x = '\ufffd'\n"]
    files = [("r", "deep.py", "x = " + "+".join(["a"] * 20000)), ("r", "open.py", "(" * 500), ("r", "none.py", None), ("r", "ok.py", "x = 1")]
    found = facts(spark.createDataFrame(files, "repo string, path string, content string"))
    assert {(r.path, r.kind) for r in found.where("kind in ('unparsed', 'module')").collect()} == {("deep.py", "unparsed"), ("open.py", "unparsed"), ("none.py", "unparsed"), ("ok.py", "module")}
    assert found.where("kind <> 'unparsed' and path <> 'ok.py'").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_route_match_is_what_comparing_all_finds(spark, seed):
    import random

    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "c", "{x}", ":y"])
    calls = [(k, r.choice(["GET", "PUT"]), [word() for _ in range(r.randrange(4))]) for k in range(120)]
    routes = [(f"r{k}", r.choice(["GET", "PUT"]), [word() for _ in range(r.randrange(4))]) for k in range(12)]
    hole = lambda s: s.startswith("{")
    fit = lambda a, b: len(a) == len(b) and all(x == y or hole(x) or hole(y) for x, y in zip(a, b))
    wanted = set()
    for k, method, seg in calls:
        first = {n for n, m, s in routes if m == method and fit(seg, s)}
        tail = {n for n, m, s in routes if m == method and len(s) != len(seg) and (w := min(len(s), len(seg))) and fit(seg[-w:], s[-w:])}
        if len(first) == 1:
            wanted.add((k, min(first), "resolved"))
        elif not first and len(tail) == 1:
            wanted.add((k, min(tail), "inferred"))
    found = relations.route_match(spark.createDataFrame(calls, "call_id long, method string, segments array<string>"), spark.createDataFrame(routes, "route string, method string, segments array<string>"))
    assert {tuple(x) for x in found.collect()} == wanted


def test_store_upserts(spark, tmp_path):
    from forkline.sources.store import Store

    store = Store(spark, str(tmp_path / "store"))
    assert store.read("code_files").count() == 0
    rows = lambda items: spark.createDataFrame([("r", p, c) for p, c in items], "repo string, path string, content string")
    assert store.put_sources(rows([("a.py", "1"), ("b.py", "1")]), F.lit("python")) == 1
    before = {r.file_path: r.updated_at for r in store.read("code_files").collect()}
    assert store.put_sources(rows([("a.py", "1"), ("b.py", "2"), ("c.py", "3")]), F.lit("python")) == 2
    after = {r.file_path: (r.content, r.updated_at) for r in store.read("code_files").collect()}
    assert {p: c for p, (c, _) in after.items()} == {"a.py": "1", "b.py": "2", "c.py": "3"}
    assert after["a.py"][1] == before["a.py"] and after["b.py"][1] > before["b.py"]


def test_rectangles_across_cells(spark):
    r = random.Random(3)
    boxes = [(k, x := r.random() * 30, y := r.random() * 30, x + r.random() * 12, y + r.random() * 12) for k in range(60)]
    df = spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double")
    wanted = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]}
    assert {tuple(p) for p in relations.rect_overlap(df, 5.0).collect()} == wanted


def test_a_long_chain_of_calls_costs_no_other_function():
    from forkline.sources.facts import UNPARSEABLE, FileFacts

    rows = FileFacts("r", "a.py", "def f(x):\n    return x" + ".a()" * 400 + "\n\n\ndef g():\n    return f(1)\n").rows
    assert not [r for r in rows if "unparsed" in r]
    assert sum(r.count(UNPARSEABLE) for r in rows) > 0 and [r for r in rows if "call" in r and "f(1)" in r]
