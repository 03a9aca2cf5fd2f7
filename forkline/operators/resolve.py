"""Name resolution over facts, as joins in order of priority."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.session import materialised


@dataclass(frozen=True)
class Index:
    """Tables of a program: one row a fact, all keyed by repo."""

    modules: DataFrame
    classes: DataFrame  # repo, cls, module, bases, is_abstract, is_protocol, line, end_line, path
    functions: DataFrame  # repo, fn, module, cls, name, is_async, line, end_line, path
    names: DataFrame  # repo, module, local, fqn: what a name in a module stands for
    ancestors: DataFrame  # repo, cls, ancestor, level
    methods: DataFrame  # repo, cls, method, fn: through ancestors, nearest first
    implementations: DataFrame  # repo, base, cls
    attributes: DataFrame  # repo, cls, attr, type


def _scoped(rows: DataFrame, names: DataFrame, known: DataFrame, written: str, out: str) -> DataFrame:
    """Column ``out``: the class that the dotted name ``written`` stands for in ``module``; null if none."""
    parts = F.split(written, r"\.")
    keyed = rows.withColumn("_root", F.element_at(parts, 1)).withColumn("_rest", F.regexp_replace(written, r"^[^.]*\.?", "."))
    met = keyed.join(names.select("repo", "module", F.col("local").alias("_root"), F.col("fqn").alias("_fqn")), ["repo", "module", "_root"], "left")
    full = F.when(F.col("_rest") == ".", F.col("_fqn")).otherwise(F.concat("_fqn", "_rest"))
    met = met.withColumn("_full", full)
    return met.join(known.select("repo", F.col("cls").alias("_full"), F.col("cls").alias(out)), ["repo", "_full"], "left").drop("_root", "_rest", "_fqn", "_full")


def ancestors(bases: DataFrame, rounds: int = 50) -> DataFrame:
    """All ancestors of each class with their breadth-first level: repo, cls, ancestor, level; a class is its own at level 0."""
    step = materialised(bases.select("repo", "cls", "base").where("base is not null and base <> cls").distinct())
    known = frontier = materialised(step.select("repo", "cls").union(step.select("repo", "base")).distinct().select("repo", "cls", F.col("cls").alias("ancestor"), F.lit(0).alias("level")))
    for level in range(1, rounds):
        ahead = frontier.join(step.select("repo", F.col("cls").alias("ancestor"), "base"), ["repo", "ancestor"]).select("repo", "cls", F.col("base").alias("ancestor")).distinct()
        frontier = materialised(ahead.join(known, ["repo", "cls", "ancestor"], "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return known
        known = known.union(frontier)
    raise RuntimeError("ancestors: rounds exceeded")


def index(facts: DataFrame) -> Index:
    """The index of a program's facts.  Of names defined twice the one of the last path counts."""
    of = lambda kind: facts.where(F.col("kind") == kind)
    modules = of("module").select("repo", F.col("name").alias("module"), "path").distinct()
    latest = lambda df, key: df.groupBy("repo", key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("repo", key)]), F.struct("path", "line")).alias("r")).select("repo", key, "r.*")
    classes = latest(of("class").select("repo", F.col("name").alias("cls"), F.col("owner").alias("module"), F.col("extra").alias("bases"), F.col("flag").alias("is_abstract"), (F.col("detail") == "protocol").alias("is_protocol"), "line", "end_line", "path"), "cls")
    functions = latest(of("function").select("repo", F.col("name").alias("fn"), F.col("owner").alias("module"), F.when(F.col("detail") != "", F.col("detail")).alias("cls"), F.try_element_at(F.split("name", r"\."), F.lit(-1)).alias("name"), F.col("flag").alias("is_async"), "line", "end_line", "path"), "fn")
    classes, functions = materialised(classes), materialised(functions)
    own = classes.select("repo", "module", F.element_at(F.split("cls", r"\."), -1).alias("local"), F.col("cls").alias("fqn")).union(functions.where("cls is null").select("repo", "module", F.col("name").alias("local"), F.col("fn").alias("fqn")))
    bound = of("import").where("name not like '*%'").groupBy("repo", F.col("owner").alias("module"), F.col("name").alias("local")).agg(F.max_by("detail", "line").alias("fqn"))
    starred = of("import").where("name like '*%'").select("repo", F.col("owner").alias("module"), F.col("detail").alias("source")).join(own.select("repo", F.col("module").alias("source"), "local", "fqn"), ["repo", "source"]).select("repo", "module", "local", "fqn")
    names = own.withColumn("tier", F.lit(0)).union(bound.withColumn("tier", F.lit(1))).union(starred.withColumn("tier", F.lit(2)))
    names = materialised(names.groupBy("repo", "module", "local").agg(F.min_by("fqn", F.struct("tier", "fqn")).alias("fqn")))
    based = _scoped(classes.select("repo", "module", "cls", F.explode("bases").alias("written")), names, classes, "written", "base")
    above = materialised(ancestors(based).unionByName(classes.select("repo", "cls", F.col("cls").alias("ancestor"), F.lit(0).alias("level"))).distinct())
    owned = functions.where("cls is not null").select("repo", F.col("cls").alias("ancestor"), F.col("name").alias("method"), "fn")
    methods = materialised(above.join(owned, ["repo", "ancestor"]).groupBy("repo", "cls", "method").agg(F.min_by("fn", F.struct("level", "ancestor")).alias("fn")))
    implementations = materialised(_implementations(classes, above, owned))
    written = of("attr").select("repo", F.col("owner").alias("cls"), F.col("name").alias("attr"), "ordinal", F.col("detail").alias("written")).join(classes.select("repo", "cls", "module"), ["repo", "cls"])
    attributes = materialised(_scoped(written, names, classes, "written", "type").where("type is not null").groupBy("repo", "cls", "attr").agg(F.max_by("type", "ordinal").alias("type")))
    inherited = above.join(attributes.withColumnRenamed("cls", "ancestor"), ["repo", "ancestor"]).groupBy("repo", "cls", "attr").agg(F.min_by("type", F.struct("level", "ancestor")).alias("type"))
    return Index(modules, classes, functions, names, above, methods, implementations, materialised(inherited))


def _implementations(classes: DataFrame, above: DataFrame, owned: DataFrame) -> DataFrame:
    """Concrete classes of abstract ones: descendants, and for protocols those that have all its methods."""
    concrete = classes.where("NOT is_abstract").select("repo", "cls")
    nominal = above.where("level > 0").join(concrete, ["repo", "cls"]).join(classes.where("is_abstract").select("repo", F.col("cls").alias("ancestor")), ["repo", "ancestor"]).select("repo", F.col("ancestor").alias("base"), "cls")
    wanted = owned.join(classes.where("is_protocol").select("repo", F.col("cls").alias("ancestor")), ["repo", "ancestor"]).select("repo", F.col("ancestor").alias("base"), "method").distinct()
    needs = wanted.groupBy("repo", "base").agg(F.count("*").alias("needs"))
    has = owned.select("repo", F.col("ancestor").alias("cls"), "method").distinct().join(concrete, ["repo", "cls"])
    structural = wanted.join(has, ["repo", "method"]).groupBy("repo", "base", "cls").agg(F.count("*").alias("has")).join(needs, ["repo", "base"]).where("has = needs and base <> cls").select("repo", "base", "cls")
    return nominal.union(structural).distinct()


def calls(facts: DataFrame, ix: Index) -> DataFrame:
    """Call rows with a key: repo, call, caller, module, cls, line, root, chain, source (a label), args, frames, in_loop."""
    rows = facts.where("kind = 'call'").select("repo", F.col("owner").alias("caller"), "line", F.col("ordinal").alias("column"), F.col("name").alias("root"), F.col("extra").alias("chain"), F.col("detail").alias("source"), "args", "frames", F.col("flag").alias("in_loop"))
    key = F.concat_ws(":", "caller", "line", "column", "args.end_line", "args.end_column", F.sha1("source"))
    return rows.join(ix.functions.select("repo", F.col("fn").alias("caller"), "module", "cls"), ["repo", "caller"]).withColumn("call", key)


def targets(rows: DataFrame, facts: DataFrame, ix: Index) -> DataFrame:
    """What each call may reach: repo, call, target, confidence (resolved or inferred); external ones are ``ext:<package>``.

    In order: methods of self or cls, through attributes of known type; local variables of known type; names of the module, through imports and classes; a
    function name that the program defines once (inferred); imports from elsewhere.  A method of an abstract class stands for those of its
    implementations, if it has any.
    """
    n = F.size("chain")
    last, first = F.try_element_at(F.col("chain"), F.lit(-1)), F.get("chain", F.lit(0))
    method = ix.methods.select("repo", F.col("cls").alias("type"), "method", F.col("fn").alias("target"))
    attr = ix.attributes.select("repo", F.col("cls").alias("holder"), F.col("attr"), "type")
    by = lambda df, tier: df.select("repo", "call", "type", "method", F.lit(tier).alias("tier"))
    selfish = rows.where("root in ('self', 'cls') and cls is not null")
    own = by(selfish.where(n == 1).select("repo", "call", F.col("cls").alias("type"), last.alias("method")), 0)
    held = selfish.where(n == 2).select("repo", "call", F.col("cls").alias("holder"), first.alias("attr"), last.alias("method"))
    through = by(held.join(attr, ["repo", "holder", "attr"]), 0)
    written = facts.where("kind = 'local'").select("repo", F.col("owner").alias("caller"), F.col("name").alias("root"), F.col("ordinal").alias("at"), F.col("detail").alias("written"))
    typed = rows.where(n.between(1, 2)).select("repo", "call", "caller", "module", "root", "chain", "line").join(written, ["repo", "caller", "root"]).where("at <= line")
    typed = typed.groupBy("repo", "call", "module", "chain").agg(F.max_by("written", "at").alias("written"))
    typed = materialised(_scoped(typed, ix.names, ix.classes, "written", "type").where("type is not null"))
    local = by(typed.where(n == 1).withColumn("method", last), 1)
    deep = typed.where(n == 2).select("repo", "call", F.col("type").alias("holder"), first.alias("attr"), last.alias("method"))
    local = local.union(by(deep.join(attr, ["repo", "holder", "attr"]), 1))
    of_type = own.union(through).union(local)
    wide = of_type.join(ix.implementations.select("repo", F.col("base").alias("type"), F.col("cls").alias("concrete")), ["repo", "type"], "left").withColumn("type", F.coalesce("concrete", "type")).drop("concrete")
    of_type = wide.join(method, ["repo", "type", "method"]).select("repo", "call", "target", "tier")
    scoped = rows.join(ix.names.select("repo", "module", F.col("local").alias("root"), "fqn"), ["repo", "module", "root"]).withColumn("full", F.when(n == 0, F.col("fqn")).otherwise(F.concat_ws(".", "fqn", F.array_join("chain", "."))))
    scoped = materialised(scoped.select("repo", "call", "fqn", "full"))
    functions = ix.functions.select("repo", F.col("fn").alias("full"), F.col("fn").alias("target"))
    made = ix.methods.where("method = '__init__'").select("repo", F.col("cls").alias("full"), F.col("fn").alias("init"))
    classes = ix.classes.select("repo", F.col("cls").alias("full")).join(made, ["repo", "full"], "left").select("repo", "full", F.coalesce("init", "full").alias("target"))
    static = ix.methods.select("repo", F.concat_ws(".", "cls", "method").alias("full"), F.col("fn").alias("target"))
    named = functions.union(classes).union(static).distinct()
    in_scope = scoped.join(named, ["repo", "full"]).select("repo", "call", "target", F.lit(2).alias("tier"))
    once = ix.functions.where("name <> '<module>'").groupBy("repo", "name").agg(F.count("*").alias("n"), F.min("fn").alias("target")).where("n = 1").select("repo", "name", "target")
    guess = rows.where("root <> ''").select("repo", "call", F.coalesce(last, "root").alias("name")).join(once, ["repo", "name"]).select("repo", "call", "target", F.lit(3).alias("tier"))
    inside = ix.modules.select("repo", F.element_at(F.split("module", r"\."), 1).alias("top")).distinct()
    outside = scoped.withColumn("top", F.element_at(F.split("fqn", r"\."), 1)).join(inside, ["repo", "top"], "left_anti").select("repo", "call", F.concat(F.lit("ext:"), "top").alias("target"), F.lit(4).alias("tier"))
    found = of_type.union(in_scope).union(guess.join(outside.select("repo", "call"), ["repo", "call"], "left_anti")).union(outside)
    best = found.groupBy("repo", "call").agg(F.min("tier").alias("tier"))
    return found.join(best, ["repo", "call", "tier"]).select("repo", "call", "target", F.when(F.col("tier") == 3, "inferred").otherwise("resolved").alias("confidence")).distinct()


def component_of(functions: DataFrame) -> DataFrame:
    """The component of each function: its class, else its module: repo, fn, component."""
    return functions.select("repo", "fn", F.coalesce("cls", "module").alias("component"))
