"""Modules of a repository: their roots, applications, what a scope covers, and the methods that tell an endpoint.

Directories are met by equal prefixes, one row for each directory above another; no pair of directory and root is compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.functions.text import path_prefixes
from forkline.operators.ranking import top_k
from forkline.operators.relations import drop_ancestors, longest_prefix, minimal_dirs
from forkline.session import materialised


def module_roots(files: DataFrame) -> DataFrame:
    """Roots of the modules that files (dir, package, entry, source: what the file's name says) make up: dir, depth.

    Directories with a package marker and none below; directories with an entry marker outside those; then tops with source and
    no root; then, for source still under no root, the directory furthest up without a root below it (the directory of the
    source where each has one).  Source at the very top makes the top a root.
    """
    dirs = materialised(files.groupBy("dir").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("package", "entry", "source")]))
    packages = materialised(drop_ancestors(dirs.where("package").select("dir")))
    whole = not packages.where("dir = ''").isEmpty()
    entries = dirs.where("entry").select("dir")
    free = entries.limit(0) if whole else longest_prefix(entries, "dir", packages.withColumnRenamed("dir", "root")).where("root is null").select("dir")
    roots = materialised(drop_ancestors(packages.union(free)))
    if not roots.where("dir = ''").isEmpty():
        return _by_depth(roots)
    top = F.split_part("dir", F.lit("/"), F.lit(1))
    sources = dirs.where("source").select("dir")
    bare = sources.where("dir <> ''").select(top.alias("dir")).distinct().join(roots.select(top.alias("dir")), "dir", "left_anti")
    if not sources.where("dir = ''").isEmpty():
        return _by_depth(roots.union(bare).union(sources.where("dir = ''")).distinct())
    known = materialised(roots.union(bare))
    left = longest_prefix(sources, "dir", known.withColumnRenamed("dir", "root")).where("root is null").select("dir")
    above = known.select(F.explode(path_prefixes(F.col("dir"))).alias("step")).distinct()  # roots and all above them
    steps = left.select("dir", F.posexplode(path_prefixes(F.col("dir"))).alias("k", "step"))
    open_ = steps.join(above, "step", "left_anti").groupBy("dir").agg(F.min_by("step", "k").alias("root"))
    more = left.join(open_, "dir", "left").select(F.coalesce("root", "dir").alias("dir")).distinct()
    return _by_depth(known.union(minimal_dirs(more)))


def _by_depth(roots: DataFrame) -> DataFrame:
    return roots.select("dir", (F.length("dir") - F.length(F.replace("dir", F.lit("/"), F.lit("")))).cast("long").alias("depth"))


def app_roots(modules: DataFrame, source_roots: DataFrame) -> DataFrame:
    """Root of each application module (module): the longest source root (root) above it, if no other module has the same; else its package.

    Names are dotted.  A module without either has none: root.
    """
    package = F.regexp_replace("module", r"\.?[^.]*$", "")
    rows = modules.select("module").distinct().select("module", package.alias("package"), F.translate(package, ".", "/").alias("at"))
    roots = source_roots.select(F.translate("root", ".", "/").alias("root"))
    named = longest_prefix(rows, "at", roots).select("module", "package", F.coalesce(F.translate("root", "/", "."), "package").alias("candidate")).where("candidate <> ''")
    shared = named.groupBy("candidate").agg(F.count("*").alias("n"))
    return named.join(shared, "candidate").select(F.when(F.col("n") == 1, F.col("candidate")).otherwise(F.col("package")).alias("root")).distinct()


def scope_coverage(dirs: DataFrame, scope: DataFrame) -> DataFrame:
    """Files of each directory (dir, a row a file) that is in none of the scope's (dir) nor below: dir, files; with ``*`` for those that are."""
    everything = not scope.where("dir in ('', '.')").isEmpty()
    placed = dirs.select("dir", F.lit("").alias("root")) if everything else longest_prefix(dirs, "dir", scope.select(F.col("dir").alias("root")))
    return placed.groupBy(F.when(F.col("root").isNotNull(), "*").otherwise(F.col("dir")).alias("dir")).agg(F.count("*").alias("files"))


def key_methods(handlers: DataFrame, functions: DataFrame, calls: DataFrame, most: int = 12) -> DataFrame:
    """What tells an endpoint: the handler's class, or itself, first, then methods of that class and what they call, by name: handler, fqn, rank.

    handlers (handler), functions (fqn, cls: null outside of classes), calls (caller, callee).  Only functions of the project count.

    What handlers of one class share is found and cut to ``most`` once for the class, so that no handler meets all methods.
    """
    own = handlers.select("handler").distinct().join(functions.select(F.col("fqn").alias("handler"), "cls"), "handler").select("handler", "cls", F.coalesce("cls", "handler").alias("fqn"))
    own = materialised(own)
    known = functions.select("fqn").union(functions.where("cls is not null").select("cls")).distinct()
    calls = calls.select("caller", "callee").join(known.withColumnRenamed("fqn", "callee"), "callee", "left_semi")
    methods = functions.join(own.select("cls").distinct(), "cls", "left_semi").select("cls", "fqn")
    called = methods.join(calls, F.col("fqn") == F.col("caller")).select("cls", F.col("callee").alias("fqn"))
    listed = top_k(methods.union(called).where("fqn <> cls").distinct(), ["cls"], [F.col("fqn")], most).select("cls", "fqn")
    free = own.where("cls is null").select("handler").join(calls, F.col("handler") == F.col("caller")).where("callee <> handler").select("handler", F.col("callee").alias("fqn")).distinct()
    rest = own.select("handler", "cls").join(listed, "cls").select("handler", "fqn").union(free).distinct()
    first = own.select("handler", "fqn")
    rows = first.withColumn("place", F.lit(0)).union(rest.join(first, ["handler", "fqn"], "left_anti").withColumn("place", F.lit(1)))
    return top_k(rows, ["handler"], [F.col("place"), F.col("fqn")], most).select("handler", "fqn", "rank")
