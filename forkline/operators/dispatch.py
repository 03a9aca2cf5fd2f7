"""Calls whose target is chosen at run time, callbacks, work in parallel and url patterns, as joins over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.operators.resolve import Index
from forkline.session import materialised
from forkline.sources.facts import VERBS

# Calls that start work in parallel.
PARALLEL = ("gather", "create_task", "TaskGroup")


def _named(rows: DataFrame, ix: Index, written: str) -> DataFrame:
    """Column ``fqn``: what the dotted name ``written`` stands for in ``module``; null if nothing known."""
    local = F.element_at(F.split(written, r"\."), 1)
    rest = F.regexp_replace(F.col(written), r"^[^.]*", "")
    return rows.withColumns({"local": local, "rest": rest}).join(ix.names, ["repo", "module", "local"], "left").withColumn("fqn", F.concat("fqn", "rest")).drop("local", "rest")


def _functions(ix: Index) -> DataFrame:
    return ix.functions.select("repo", "fn").union(ix.methods.select("repo", F.concat_ws(".", "cls", "method"))).distinct()


def table_arms(facts: DataFrame, ix: Index) -> DataFrame:
    """Arms of lookups in tables of the module: repo, site, owner, idx, label (the key), handler (null if no function of the program)."""
    asked = facts.where("kind = 'lookup'").select("repo", "owner", "line", F.col("ordinal").alias("column"), F.col("name").alias("table"))
    asked = asked.join(ix.functions.select("repo", F.col("fn").alias("owner"), "module"), ["repo", "owner"])
    entry = facts.where("kind = 'table'").select("repo", F.col("owner").alias("module"), F.col("name").alias("table"), F.col("ordinal").alias("idx"), F.col("extra")[0].alias("label"), F.col("detail").alias("written"))
    met = _named(asked.join(entry, ["repo", "module", "table"]), ix, "written")
    known = _functions(ix).select("repo", F.col("fn").alias("fqn"), F.col("fn").alias("handler"))
    return met.join(known, ["repo", "fqn"], "left").select("repo", F.concat_ws(":", "owner", "line", "column").alias("site"), "owner", "idx", "label", "handler")


def callbacks(facts: DataFrame, targets: DataFrame, ix: Index) -> DataFrame:
    """Functions of the program that are given to calls: repo, caller, line, target; all of them inferred.

    The caller is the first target of the call inside the program, else the function that has the call.
    """
    key = F.concat_ws(":", "owner", "line", "ordinal", "args.end_line", "args.end_column", F.sha1("detail"))
    given = facts.where("kind = 'argref'").select("repo", "owner", "line", key.alias("call"), F.concat_ws(".", F.array("name"), "extra").alias("written"))
    given = given.join(ix.functions.select("repo", F.col("fn").alias("owner"), "module"), ["repo", "owner"])
    given = _named(given, ix, "written").join(_functions(ix).select("repo", F.col("fn").alias("fqn")), ["repo", "fqn"], "left_semi")
    inside = targets.where("target not like 'ext:%'").groupBy("repo", "call").agg(F.min("target").alias("first"))
    return given.join(inside, ["repo", "call"], "left").select("repo", F.coalesce("first", "owner").alias("caller"), "line", F.col("fqn").alias("target")).distinct()


def parallel(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Lines that start work in parallel, with the functions of the program called there: repo, caller, line, callees (in order of name)."""
    lines = calls.where((F.size("chain") > 0) & F.try_element_at("chain", F.lit(-1)).isin(*PARALLEL)).select("repo", "caller", "line").distinct()
    called = calls.select("repo", "caller", "line", "call").join(targets.where("target not like 'ext:%'"), ["repo", "call"])
    return lines.join(called, ["repo", "caller", "line"], "left").groupBy("repo", "caller", "line").agg(F.array_sort(F.collect_set("target")).alias("callees"))


def url_routes(facts: DataFrame, ix: Index, rounds: int = 50) -> DataFrame:
    """Routes of url patterns from the modules that no other includes: repo, method (or any), route_path, handler.

    An include adds its route before those of the module that it names; a module does not include itself again on the way
    down.  A class gives a route for each of its methods named by a verb, own or inherited, else one for ``dispatch``.
    """
    pattern = materialised(facts.where("kind = 'pattern'").select("repo", F.col("owner").alias("module"), F.col("name").alias("route"), F.col("detail").alias("kind"), F.col("extra")[0].alias("written")))
    modules = pattern.select("repo", F.col("module").alias("to")).distinct()
    include = _named(pattern.where("kind = 'include'"), ix, "written").select("repo", "module", "route", F.coalesce("fqn", "written").alias("to"))
    include = materialised(include.join(modules, ["repo", "to"], "left_semi"))
    start = pattern.select("repo", "module").distinct().join(include.where("to <> module").select("repo", F.col("to").alias("module")), ["repo", "module"], "left_anti")
    found = frontier = materialised(start.select("repo", "module", F.lit("").alias("prefix"), F.array("module").alias("way")))
    for _ in range(rounds):
        down = frontier.join(include, ["repo", "module"]).where("not array_contains(way, to)")
        frontier = materialised(down.select("repo", F.col("to").alias("module"), F.concat("prefix", "route").alias("prefix"), F.concat("way", F.array("to")).alias("way")))
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    else:
        raise RuntimeError(f"url patterns: includes deeper than {rounds}")
    full = _named(pattern.where("kind <> 'include'"), ix, "written").join(found.select("repo", "module", "prefix"), ["repo", "module"]).select("repo", "kind", "fqn", F.concat("prefix", "route").alias("route_path"))
    views = full.where("kind = 'view'").join(_functions(ix).select("repo", F.col("fn").alias("fqn")), ["repo", "fqn"], "left_semi").select("repo", F.lit("any").alias("method"), "route_path", F.col("fqn").alias("handler"))
    method = ix.methods.where(F.col("method").isin(*VERBS, "dispatch")).select("repo", F.col("cls").alias("fqn"), "method", F.col("fn").alias("handler"))
    classes = full.where("kind = 'class'").join(method, ["repo", "fqn"])
    verbs = classes.where("method <> 'dispatch'").select("repo", "fqn", "method", "route_path", "handler")
    others = classes.where("method = 'dispatch'").join(verbs.select("repo", "fqn").distinct(), ["repo", "fqn"], "left_anti").select("repo", F.lit("any").alias("method"), "route_path", "handler")
    return views.union(verbs.select("repo", "method", "route_path", "handler")).union(others).distinct()
