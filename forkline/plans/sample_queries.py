"""The analysis over the sample program; the SQL states the answers worked out by hand."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.operators import flow as W
from forkline.operators import slicing
from forkline.plans.analysis import Analysis
from forkline.plans.sample import sources


@lru_cache(maxsize=1)
def _analysis(spark: SparkSession) -> Analysis:
    return Analysis(sources(spark))


def parse_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _analysis(spark).index
    return ix.functions.select("fn", "module", F.coalesce("cls", F.lit("")).alias("cls"), "line")


def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets inside the program."""
    a = _analysis(spark)
    return a.calls.join(a.targets.where("target not like 'ext:%'"), ["repo", "call"]).select("caller", "line", "target", "confidence").distinct()


def external_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark)
    return a.calls.join(a.targets.where("target like 'ext:%'"), ["repo", "call"]).groupBy("caller", "target").agg(F.count("*").alias("n"))


def fork_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.regexp_extract("site", r":(\d+):", 1).cast("int")
    return _analysis(spark).verdicts.select("owner", line.alias("line"), "kind", "arms", "live", "verdict")


def route_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark).routes.select("handler", "method", "route_path")


def stitch_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark).links.select("owner", "route", "handler", "confidence")


def effect_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark).effects.select("owner", "kind", "method", F.coalesce("target", F.lit("")).alias("target"))


def endpoint_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark)
    name = lambda c: F.regexp_replace(c, r"^sample\|", "").alias(c)
    return a.slice(a.routes).select(name("handler"), name("fn"), "distance")


def endpoint_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark).catalog().select("entry", "label", "route_count")


def implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark).index.implementations.select("base", "cls")


def component_pillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark).pillars.where("hub + authority > 0").select("node", "hub", "authority")


@lru_cache(maxsize=1)
def _flow(spark: SparkSession) -> W.Flow:
    return W.condensed(_analysis(spark))


@lru_cache(maxsize=1)
def _members(spark: SparkSession) -> DataFrame:
    flow = _flow(spark)
    return slicing.members(flow.edges, flow.nodes.where("kind = 'entry'").select(F.col("id").alias("entry")))


def flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark).nodes.groupBy("kind").agg(F.count("*").alias("n"))


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark).edges.select("source", "target", "kind", "arm_label", "confidence")


def flow_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes or edges break a condition."""
    return W.problems(_flow(spark)).agg(F.count("*").alias("n"))


def slice_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six nodes of each slice."""
    flow = _flow(spark)
    return slicing.chosen(_members(spark), flow.edges, flow.nodes, 6).select("entry", "node", "place")


def slice_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = _flow(spark)
    kept = slicing.chosen(_members(spark), flow.edges, flow.nodes, 6)
    return slicing.hosted(_members(spark), flow.edges, kept)


def slice_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow, found = _flow(spark), _members(spark)
    inner = slicing.acyclic(slicing.inner_edges(flow.edges, found))
    return W.tree_layout(W.forest(inner, found), found)


def layout_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.overlaps(slice_layout(spark, sf_dir), _flow(spark).nodes).agg(F.count("*").alias("n"))


def _values(columns: str, rows: list[tuple]) -> str:
    say = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) AS t({columns})"


S = "shop.service"
SQL = {
    "parse_functions": _values("fn, module, cls, line", [
        ("shop.main.<module>", "shop.main", "", 1), ("shop.orders.<module>", "shop.orders", "", 1), ("shop.orders.read_order", "shop.orders", "", 9), ("shop.orders.create_order", "shop.orders", "", 14),
        (f"{S}.<module>", S, "", 1), (f"{S}.Channel.send", S, f"{S}.Channel", 6), (f"{S}.Notifier.send", S, f"{S}.Notifier", 9), (f"{S}.Silent.send", S, f"{S}.Silent", 13),
        (f"{S}.Base.load", S, f"{S}.Base", 17), (f"{S}.OrderService.__init__", S, f"{S}.OrderService", 21), (f"{S}.OrderService.express", S, f"{S}.OrderService", 24), (f"{S}.OrderService.bulk", S, f"{S}.OrderService", 28),
        (f"{S}.fetch", S, "", 32), (f"{S}.pack", S, "", 35), (f"{S}.log", S, "", 41),
        ("stock.api.<module>", "stock.api", "", 1), ("stock.api.item", "stock.api", "", 6), ("stock.api.lookup", "stock.api", "", 9), ("stock.api.zero", "stock.api", "", 17), ("stock.api.many", "stock.api", "", 20),
        ("shop.empty.<module>", "shop.empty", "", 1),
    ]),
    "resolve_calls": _values("caller, line, target, confidence", [(c, n, t, "resolved") for c, n, t in [
        ("shop.orders.read_order", 10, f"{S}.OrderService.__init__"), ("shop.orders.read_order", 10, f"{S}.Notifier"), ("shop.orders.read_order", 11, f"{S}.Base.load"),
        ("shop.orders.create_order", 15, f"{S}.OrderService.__init__"), ("shop.orders.create_order", 15, f"{S}.Notifier"), ("shop.orders.create_order", 17, f"{S}.OrderService.express"), ("shop.orders.create_order", 19, f"{S}.OrderService.bulk"),
        (f"{S}.Silent.send", 14, f"{S}.log"), (f"{S}.Base.load", 18, f"{S}.fetch"), (f"{S}.OrderService.express", 25, f"{S}.Notifier.send"), (f"{S}.OrderService.express", 25, f"{S}.Silent.send"), (f"{S}.OrderService.express", 26, f"{S}.fetch"),
        (f"{S}.OrderService.bulk", 30, f"{S}.pack"), (f"{S}.pack", 37, f"{S}.fetch"), (f"{S}.pack", 39, f"{S}.log"),
        ("stock.api.item", 7, "stock.api.lookup"), ("stock.api.lookup", 12, "stock.api.zero"), ("stock.api.lookup", 14, "stock.api.many"), ("stock.api.many", 21, "stock.api.zero"),
    ]]),
    "external_calls": _values("caller, target, n", [("shop.main.<module>", "ext:fastapi", 1), ("shop.orders.<module>", "ext:fastapi", 1), ("shop.orders.create_order", "ext:requests", 1), (f"{S}.fetch", "ext:sqlite3", 1), ("stock.api.<module>", "ext:fastapi", 1)]),
    "fork_verdicts": _values("owner, line, kind, arms, live, verdict", [
        ("shop.orders.create_order", 16, "branch", 3, 2, "noise"), (f"{S}.OrderService.express", 25, "polymorphic", 2, 2, "decision"), (f"{S}.pack", 36, "except", 2, 1, "guarded_step"), ("stock.api.lookup", 10, "match", 2, 0, "noise"),
    ]),
    "route_entries": _values("handler, method, route_path", [("shop.orders.read_order", "GET", "/orders/{order_id}"), ("shop.orders.create_order", "POST", "/orders/"), ("stock.api.item", "GET", "/stock/items/{item}")]),
    "stitch_links": _values("owner, route, handler, confidence", [("shop.orders.create_order", "GET /stock/items/{item}", "stock.api.item", "resolved")]),
    "effect_sites": _values("owner, kind, method, target", [("shop.orders.create_order", "http_out", "get", "/stock/items/7"), (f"{S}.fetch", "db", "connect", "")]),
    "endpoint_slice": _values("handler, fn, distance", [
        *(("shop.orders.create_order", f, d) for f, d in [("shop.orders.create_order", 0), (f"{S}.OrderService.__init__", 1), (f"{S}.Notifier", 1), (f"{S}.OrderService.express", 1), (f"{S}.OrderService.bulk", 1), (f"{S}.Notifier.send", 2), (f"{S}.Silent.send", 2), (f"{S}.fetch", 2), (f"{S}.pack", 2), (f"{S}.log", 3)]),
        *(("shop.orders.read_order", f, d) for f, d in [("shop.orders.read_order", 0), (f"{S}.OrderService.__init__", 1), (f"{S}.Notifier", 1), (f"{S}.Base.load", 1), (f"{S}.fetch", 2)]),
        *(("stock.api.item", f, d) for f, d in [("stock.api.item", 0), ("stock.api.lookup", 1), ("stock.api.zero", 2), ("stock.api.many", 2)]),
    ]),
    "endpoint_catalog": _values("entry, label, route_count", [("entry:stock.api.item", "GET /stock/items/{item}", 1), ("entry:group:shop.orders", "Orders · 2 routes", 2)]),
    "flow_problems": "SELECT 0 AS n",
    "layout_overlaps": "SELECT 0 AS n",
    "implementations": _values("base, cls", [(f"{S}.Channel", f"{S}.Notifier"), (f"{S}.Channel", f"{S}.Silent")]),
}

QUERIES = {f.__name__: f for f in (parse_functions, resolve_calls, external_calls, fork_verdicts, route_entries, stitch_links, effect_sites, endpoint_slice, endpoint_catalog, implementations, component_pillars, flow_nodes, flow_edges, flow_problems, slice_budget, slice_hosts, slice_layout, layout_overlaps)}
