"""The analysis of a program: sources to calls, forks, verdicts, entries, scores, links and slices, all as tables.

Tables hold any number of repositories; keys begin with ``repo``, so that the work spreads over them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.functions import text as T
from forkline.operators import graph, ranking, relations, resolve
from forkline.session import materialised
from forkline.sources.facts import facts

# Effects by external package and method; the first rule that fits counts.
EFFECT_RULES = [
    ("http_out", ["requests", "httpx", "aiohttp", "urllib"], []),
    ("db", ["sqlalchemy", "psycopg", "psycopg2", "asyncpg", "sqlite3", "pymongo"], []),
    ("cache", ["redis", "memcache"], []),
    ("queue", ["celery", "kombu", "pika", "boto3", "botocore"], []),
    ("file", ["shutil", "pathlib", "os"], ["write_text", "write_bytes", "unlink", "remove", "mkdir", "rename", "copy", "move"]),
    ("mail", ["smtplib", "sendgrid"], []),
    ("llm", ["openai", "anthropic", "litellm"], []),
]


@dataclass
class Analysis:
    """Lazily built tables over sources (repo, path, content)."""

    sources: DataFrame

    @cached_property
    def facts(self) -> DataFrame:
        return materialised(facts(self.sources))

    @cached_property
    def index(self) -> resolve.Index:
        return resolve.index(self.facts)

    @cached_property
    def calls(self) -> DataFrame:
        return materialised(resolve.calls(self.facts, self.index))

    @cached_property
    def targets(self) -> DataFrame:
        return materialised(resolve.targets(self.calls, self.facts, self.index))

    @cached_property
    def call_graph(self) -> DataFrame:
        """Edges between functions of the program: repo, src, dst (``repo|fn``), calls."""
        name = lambda c: F.concat_ws("|", "repo", c)
        edges = self.calls.join(self.targets.where("target not like 'ext:%'"), ["repo", "call"])
        return materialised(edges.groupBy("repo", name("caller").alias("src"), name("target").alias("dst")).agg(F.count("*").alias("calls")))

    @cached_property
    def reach(self) -> DataFrame:
        """Components that each function reaches, its own included: fn (``repo|fn``), component."""
        component = resolve.component_of(self.index.functions).select(F.concat_ws("|", "repo", "fn").alias("dst"), "component")
        closure = graph.doubled_closure(self.call_graph)
        pairs = closure.union(component.select(F.col("dst").alias("src"), "dst")).distinct()
        return materialised(pairs.join(component, "dst").select(F.col("src").alias("fn"), "component").distinct())

    @cached_property
    def arms(self) -> DataFrame:
        """Arms of forks with the components that their calls reach: repo, site, owner, kind, idx, label, terminal, reach."""
        arm = self.facts.where("kind = 'arm'").select("repo", "owner", "ordinal", F.col("name").alias("label"), F.col("detail").alias("terminal"), F.concat_ws(":", "owner", F.col("extra")[0], F.col("extra")[1]).alias("site"), F.col("extra")[2].cast("int").alias("from_line"), F.col("extra")[3].cast("int").alias("to_line"))
        fork = self.facts.where("kind = 'fork'").select("repo", F.concat_ws(":", "owner", "line", "ordinal").alias("site"), F.col("name").alias("kind"), F.col("flag").alias("reconverges"))
        spans = arm.join(fork, ["repo", "site"])
        inner = self.calls.select("repo", F.col("caller").alias("owner"), "call", "line").join(self.targets.where("target not like 'ext:%'"), ["repo", "call"])
        hit = spans.join(inner, ["repo", "owner"]).where("line between from_line and to_line").select("repo", "site", "ordinal", F.concat_ws("|", "repo", "target").alias("fn"))
        reached = hit.join(self.reach, "fn").groupBy("repo", "site", "ordinal").agg(F.array_sort(F.collect_set("component")).alias("reach"))
        poly = self._polymorphic()
        out = spans.join(reached, ["repo", "site", "ordinal"], "left").select("repo", "site", "owner", "kind", F.col("ordinal").alias("idx"), "label", "terminal", "reconverges", F.coalesce("reach", F.array().cast("array<string>")).alias("reach"))
        return materialised(out.unionByName(poly))

    def _polymorphic(self) -> DataFrame:
        """Calls with two targets or more are forks, an arm a target."""
        many = self.targets.where("target not like 'ext:%'").groupBy("repo", "call").agg(F.array_sort(F.collect_set("target")).alias("all")).where("size(all) >= 2")
        arm = many.join(self.calls.select("repo", "call", "caller"), ["repo", "call"]).select("repo", F.col("call").alias("site"), F.col("caller").alias("owner"), F.posexplode("all").alias("idx", "target"))
        reached = self.reach.groupBy("fn").agg(F.array_sort(F.collect_set("component")).alias("reach"))
        label = F.try_element_at(F.split("target", r"\."), F.lit(-2))
        out = arm.withColumn("fn", F.concat_ws("|", "repo", "target")).join(reached, "fn", "left")
        return out.select("repo", "site", "owner", F.lit("polymorphic").alias("kind"), "idx", label.alias("label"), F.lit("falls_through").alias("terminal"), F.lit(True).alias("reconverges"), F.coalesce("reach", F.array().cast("array<string>")).alias("reach"))

    @cached_property
    def routes(self) -> DataFrame:
        """Handlers with method and full path: repo, handler, method, route_path."""
        included = self.calls.where("coalesce(try_element_at(chain, -1), root) = 'include_router' and args.name <> '' and args.prefix <> ''").select("repo", "module", "line", F.col("args.name").alias("router"), F.col("args.prefix").alias("prefix"))
        first = included.withColumns({"local": F.element_at(F.split("router", r"\."), 1), "rest": F.regexp_replace("router", r"^\w+", "")})
        bound = first.join(self.index.names, ["repo", "module", "local"], "left").select("repo", "line", "prefix", F.concat(F.coalesce("fqn", F.concat_ws(".", "module", "local")), "rest").alias("variable"))
        bound = bound.groupBy("repo", "variable").agg(F.max_by("prefix", "line").alias("prefix"))
        rows = self.facts.where("kind = 'route'").select("repo", F.col("owner").alias("handler"), F.col("name").alias("method"), F.col("detail").alias("own"), F.col("extra")[0].alias("router"))
        named = rows.join(self.index.functions.select("repo", F.col("fn").alias("handler"), "module"), ["repo", "handler"]).withColumn("variable", F.concat_ws(".", "module", "router"))
        return materialised(named.join(bound, ["repo", "variable"], "left").select("repo", "handler", "method", F.concat(F.coalesce("prefix", F.lit("")), "own").alias("route_path")))

    @cached_property
    def verdicts(self) -> DataFrame:
        """Verdict and score of each fork: repo, site, kind, arms, live, verdict, score."""
        keyed = self.arms.withColumn("site", F.concat_ws("|", "repo", "site"))
        verdict = ranking.site_verdicts(keyed)
        live = keyed.where(ranking.arm_class(F.col("terminal"), F.size("reach")) == "live").select("site", F.explode("reach").alias("component")).groupBy("site").agg(F.countDistinct("component").alias("distinct_reach"))
        handler = self.routes.select(F.concat_ws("|", "repo", "handler").alias("src")).distinct()
        from_route = self.call_graph.join(handler, "src", "left_semi").select(F.col("dst").alias("fn")).union(handler.select(F.col("src").alias("fn"))).distinct().withColumn("routed", F.lit(1))
        about = keyed.groupBy("site").agg(F.first("repo").alias("repo"), F.first("owner").alias("owner"), F.max("reconverges").alias("reconverges")).withColumn("fn", F.concat_ws("|", "repo", "owner")).join(from_route, "fn", "left")
        score = ranking.site_score(F.coalesce("distinct_reach", F.lit(0)), F.coalesce("routed", F.lit(0)), F.col("reconverges"), F.col("kind"))
        return materialised(verdict.join(live, "site", "left").join(about, "site").select("repo", "owner", "site", "kind", "arms", "live", "verdict", F.round(score, 6).alias("score")))

    @cached_property
    def effects(self) -> DataFrame:
        """Effects of calls to external packages: repo, owner, kind, method, target, line.  Packages of one line count for all its calls."""
        rule = F.lit(None).cast("string")
        for kind, packages, methods in reversed(EFFECT_RULES):
            fits = F.col("package").isin(*packages)
            rule = F.when(fits & F.col("method").isin(*methods) if methods else fits, kind).otherwise(rule)
        external = self.targets.where("target like 'ext:%'").select("repo", "call", F.substr("target", F.lit(5)).alias("package"))
        rows = self.calls.join(external, ["repo", "call"]).select("repo", F.col("caller").alias("owner"), "line", "args", F.lower(F.coalesce(F.try_element_at(F.col("chain"), F.lit(-1)), "root")).alias("method"), "package")
        text = F.when(F.col("kind") == "db", T.sql_table(F.col("args.statement"))).when(F.col("kind") == "http_out", F.col("args.first")).otherwise(F.col("args.literal"))
        target = F.coalesce(text, F.lit(""))
        return materialised(rows.withColumn("kind", rule).where("kind is not null").select("repo", "owner", "kind", "method", target.alias("target"), "line"))

    @cached_property
    def pillars(self) -> DataFrame:
        """Hub and authority of components, without utilities: node (``repo|component``), hub, authority."""
        component = resolve.component_of(self.index.functions).select(F.concat_ws("|", "repo", "fn").alias("fn"), F.concat_ws("|", "repo", "component").alias("component"))
        both = self.call_graph.join(component.select(F.col("fn").alias("src"), F.col("component").alias("a")), "src").join(component.select(F.col("fn").alias("dst"), F.col("component").alias("b")), "dst")
        utility = ranking.utility_fan_in(both.select(F.col("src").alias("caller"), F.col("a").alias("src"), F.col("b").alias("dst"))).where("utility").select(F.col("dst").alias("b"))
        edges = both.where("a <> b").join(utility, "b", "left_anti").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("calls").alias("weight"))
        return materialised(graph.hits(edges))

    @cached_property
    def links(self) -> DataFrame:
        """Outgoing requests that name a route of another handler: repo, owner, line, route, handler, confidence."""
        out = self.effects.where("kind = 'http_out'").withColumn("segments", T.normalize_out_path(F.col("target"))).where("segments is not null")
        calls = out.select(F.concat_ws("|", "repo", "owner", "line", "target").alias("call_id"), F.upper("method").alias("method"), "segments", "repo", "owner", "line")
        routes = self.routes.select("handler", "method", "route_path", T.split_segments(F.col("route_path")).alias("segments"))
        named = routes.select(F.concat_ws(" ", "method", "route_path").alias("route"), "method", "segments", "handler")
        found = relations.route_match(calls.select("call_id", "method", "segments"), named.drop("handler"))
        return found.join(calls.select("call_id", "repo", "owner", "line"), "call_id").join(named.select("route", "handler"), "route").select("repo", "owner", "line", "route", "handler", "confidence")

    def slice(self, handlers: DataFrame) -> DataFrame:
        """Functions within reach of each handler (repo, handler): handler, fn, distance."""
        roots = handlers.select(F.concat_ws("|", "repo", "handler").alias("root")).distinct()
        known = frontier = materialised(roots.select("root", F.col("root").alias("fn"), F.lit(0).alias("distance")))
        step = self.call_graph.select(F.col("src").alias("fn"), "dst")
        for distance in count(1):  # each round but the last adds functions
            ahead = frontier.join(step, "fn").select("root", F.col("dst").alias("fn")).distinct()
            frontier = materialised(ahead.join(known, ["root", "fn"], "left_anti").withColumn("distance", F.lit(distance)))
            if frontier.isEmpty():
                break
            known = known.union(frontier)
        return known.select(F.col("root").alias("handler"), "fn", "distance")

    def catalog(self) -> DataFrame:
        """Entries: routes of a module as one group if there are two or more; repo, entry, label, route_count."""
        module = self.index.functions.select("repo", F.col("fn").alias("handler"), "module")
        routed = self.routes.join(module, ["repo", "handler"])
        sized = routed.groupBy("repo", "module").agg(F.count("*").alias("route_count"), F.min(F.struct("handler", "method", "route_path")).alias("first"))
        single = F.col("route_count") == 1
        entry = F.when(single, F.concat(F.lit("entry:"), "first.handler")).otherwise(F.concat(F.lit("entry:group:"), "module"))
        label = F.when(single, F.concat_ws(" ", "first.method", "first.route_path")).otherwise(F.concat(T.humanize(F.col("module")), F.lit(" · "), F.col("route_count").cast("string"), F.lit(" routes")))
        return sized.select("repo", entry.alias("entry"), label.alias("label"), "route_count").orderBy(F.lower("label"), "entry")
