"""Bodies, folds and module roots against plain Python that goes one step after another."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from forkline.operators import bodies, folding, modules


def _dirs(roots, d):
    return any(r == "" or d == r or d.startswith(r + "/") for r in roots)


def plain_roots(files):
    """Directory by directory, in sorted order."""
    tops = lambda s: {d for d in s if not any(o != d and o.startswith(d + "/" if d else "") for o in s)}
    packages = tops({d for d, p, _, _ in files if p})
    roots = tops(packages | {d for d, _, e, _ in files if e and not _dirs(packages, d)})
    if "" in roots:
        return roots
    sources = {d for d, _, _, s in files if s}
    roots |= {d.split("/")[0] for d in sources if d and not any(r.split("/")[0] == d.split("/")[0] for r in roots)}
    if "" in sources:
        return roots | {""}
    for d in sorted(sources):
        if not _dirs(roots, d):
            steps = ["/".join(d.split("/")[: k + 1]) for k in range(d.count("/") + 1)]
            roots |= {next((s for s in steps if not any(r.startswith(s + "/") for r in roots)), d)}
    return roots


def test_module_roots_as_one_directory_after_another(spark):
    rng = random.Random(7)
    for case in range(4):
        files = [("/".join(rng.choice("abc") for _ in range(rng.randint(0 if case % 4 == 3 else 1, 4))), rng.random() < 0.15, rng.random() < 0.15, rng.random() < 0.6) for _ in range(25)]
        df = spark.createDataFrame(files, "dir string, package boolean, entry boolean, source boolean")
        assert {r.dir for r in modules.module_roots(df).collect()} == plain_roots(files), files
    assert modules.module_roots(df.limit(0)).collect() == []


def test_body_order_with_cycles_and_missing_places(spark):
    contained = spark.createDataFrame([(n, "o") for n in "abcdef"] + [("x", "p"), ("o", None)], "node string, container string")
    edges = spark.createDataFrame([("c", "a"), ("c", "a"), ("b", "a"), ("d", "e"), ("e", "d"), ("f", "x")], "src string, dst string")
    places = spark.createDataFrame([("f", "m", 1), ("b", "m", 9), ("c", "m", 3)], "node string, file string, line int")
    order = {(r.owner, r.node): r.place for r in bodies.body_order(contained, edges, places).collect()}
    assert [n for (o, n), _ in sorted(order.items(), key=lambda kv: kv[1]) if o == "o"] == ["f", "c", "b", "a", "d", "e"]
    assert order["p", "x"] == 0
    assert {r.node for r in bodies.body_tails(contained, edges).collect()} == {"a", "f", "x"}


def test_cycles_of_containers(spark):
    contained = spark.createDataFrame([("r", None), ("a", "b"), ("b", "a"), ("c", "r"), ("d", "gone"), ("e", "e")], "node string, container string")
    found = {(r.problem, r.node) for r in bodies.structure_problems(contained, "r").collect()}
    assert found == {("cycle", "a"), ("cycle", "b"), ("cycle", "e"), ("missing", "d"), ("orphan", "a"), ("orphan", "b"), ("orphan", "d"), ("orphan", "e")}


def test_folds_stop_at_the_floor_and_go_on_with_smaller_ones(spark):
    kept = spark.createDataFrame([("s", f"n{k}", k == 0) for k in range(12)], "entry string, node string, root boolean")
    owners = spark.createDataFrame([("n0", "a")] + [(f"n{k}", "a" if k < 5 else "b" if k < 7 else "c") for k in range(1, 10)] + [("n10", ""), ("n11", None)], "node string, owner string")
    shared = spark.createDataFrame([("a", 10), ("b", 12), ("c", 9)], "owner string, n long")
    hosts = folding.helper_hosts(kept, owners, shared, floor=10)
    assert {(r.node, r.host) for r in hosts.collect()} == {("n5", "helper:b"), ("n6", "helper:b")}  # a would leave 9
    wide = folding.helper_hosts(kept, owners, shared, floor=8)
    assert {r.host for r in wide.collect()} == {"helper:a", "helper:b"}
    assert "n0" not in {r.node for r in wide.collect()}
    assert folding.helper_hosts(kept.limit(0), owners, shared).collect() == []


def test_forks_and_roots_end_runs(spark):
    names = ["r", "a", "b", "c", "d", "f", "g", "h", "i"]
    kept = spark.createDataFrame([("s", n, n == "r") for n in names], "entry string, node string, root boolean")
    pairs = [("r", "a"), ("r", "g"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "f"), ("f", "g"), ("g", "h"), ("h", "i")]
    edges = spark.createDataFrame([("s", *p) for p in pairs], "entry string, source string, target string")
    forks = spark.createDataFrame([("s", "d")], "entry string, node string")
    hosts = {r.node: r.host for r in folding.run_hosts(kept, edges, forks, floor=1).collect()}
    assert hosts == {"a": "run:a", "b": "run:a", "c": "run:a", "g": "run:g", "h": "run:g", "i": "run:g"}
    left = folding.absorbed(edges, spark.createDataFrame([("s", n, h) for n, h in hosts.items()], "entry string, node string, host string"))
    assert {(r.source, r.target) for r in left.collect()} == {("r", "run:a"), ("r", "run:g"), ("run:a", "d"), ("d", "f"), ("f", "run:g")}


def test_only_children_are_shown(spark):
    found = spark.createDataFrame([("r", n) for n in "rabcdefg"], "entry string, node string")
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("r", "c"), ("c", "d"), ("c", "e"), ("b", "f"), ("f", "g")], "source string, target string").withColumn("kind", F.lit("sequence"))
    kept = found.where("node in ('r', 'a', 'c', 'f')")
    assert {r.node for r in folding.sole_children(found, edges, kept).collect()} == {"r", "a", "b", "c", "f", "g"}
    assert {r.node for r in folding.sole_children(found, edges, kept, rounds=0).collect()} == {"r", "a", "c", "f"}
