"""URL filters: a sort-merge range join of reversed-host keys against prefix rules, in DataFrame operations only.

A rule is (host, path, verdict).  It fits its host and every subdomain whose path starts with the rule's.  The
canonical key of a url at depth k is its last k host labels reversed, then its path; a rule's key is all its labels
reversed, then its path.  At the rule's depth the urls it fits are one interval of the sorted keys, and the intervals
of the rules of one host nest.  A sorted sweep (a window per host suffix and salt) meets rules and urls in key order:
the rule met last carries the stack of the rules it is nested in, and the innermost of these that is a prefix of the
url's path is the one in force.  (If rule q fits a url and rule r is met between them, r starts with q, so q is on r's
stack: nothing is lost by looking at the last rule alone.)

Skew: urls of one host suffix are dealt over ``salts`` groups, each with a copy of the rules, so that a host with a
third of all rows is swept by many tasks.  Stack depth is bounded by a rule's path length, probes a url by the labels
of the deepest rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased) and path (then up to ``?`` or ``#``).

    Null urls and those without ``://`` have both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule with the stack of rules of the same host whose path is a prefix of its own (itself included)."""
    prefixes = rules.select(
        "host", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.left(F.col("path"), n))).alias("inner")
    )
    named = rules.select("host", F.col("path").alias("inner"), "verdict")
    return (
        prefixes.join(named, ["host", "inner"])
        .groupBy("host", "path")
        .agg(F.array_sort(F.collect_list(F.struct(F.length("inner").alias("size"), F.col("inner"), F.col("verdict")))).alias("stack"))
    )


def url_filters(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = (), default: str = "allow", salts: int = 64) -> DataFrame:
    """Judge every url: columns ``keep``, host, path, rule (host + path of the rule, or null) and verdict.

    The longest rule wins (by characters of host and path; then the longer host).  Of rules given twice with both
    verdicts, ``block`` holds; rules with a null or empty host are ignored and a null rule path is empty.  A null url
    or one without ``://`` has empty host and path, no rule and the default verdict.  One row comes out for each row
    that goes in, repeated rows included; empty tables give empty results.  Columns of ``keep`` may have any names.
    """
    host, path = url_parts(F.col(url))
    given = pages.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.lit(0).alias("none")).alias("kept"), host.alias("host"), path.alias("path"))
    given = given.withColumn("row", F.monotonically_increasing_id())
    clean = (
        rules.where(F.coalesce("host", F.lit("")) != "")
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.max("verdict").alias("any"), F.max(F.when(F.col("verdict") == "block", "block")).alias("block"))
        .select("host", "path", F.coalesce("block", "any").alias("verdict"))
    )
    labels = F.size(F.split("host", r"\."))
    deepest = clean.agg(F.max(labels)).first()[0] or 0
    # Reversed labels joined again: "com.example" for example.com, so that suffixes of hosts are prefixes of keys.
    flipped = F.reverse(F.split("host", r"\."))
    depths = F.when(F.col("host") == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.least(F.lit(max(deepest, 1)), labels)))
    probes = given.select("kept", "host", "path", "row", F.explode_outer(depths).alias("depth")).select(
        "kept", "host", "path", "row",
        F.array_join(F.slice(flipped, F.lit(1), F.coalesce("depth", F.lit(0))), ".").alias("domain"),
        F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"),
        F.lit(None).cast("array<struct<size:int,inner:string,verdict:string>>").alias("stack"),
    )
    entries = _stacks(clean).select(
        F.lit(None).cast(probes.schema["kept"].dataType).alias("kept"), "host", "path", F.lit(None).cast("long").alias("row"),
        F.array_join(flipped, ".").alias("domain"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "stack",
    )
    sweep = Window.partitionBy("domain", "salt").orderBy("path", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = probes.unionByName(entries).withColumn("met", F.last("stack", ignorenulls=True).over(sweep)).where(F.col("row").isNotNull())
    active = F.filter("met", lambda r: F.startswith(F.col("path"), r["inner"]))
    suffix = F.array_join(F.reverse(F.split("domain", r"\.")), ".")
    top = F.try_element_at(active, F.lit(-1))
    found = met.withColumn(
        "hit",
        F.when(F.size(active) > 0, F.struct((F.length(suffix) + top["size"]).alias("size"), F.length(suffix).alias("host_size"), F.concat(suffix, top["inner"]).alias("rule"), top["verdict"].alias("verdict"))),
    )
    best = found.groupBy("row").agg(F.first("kept").alias("kept"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("hit").alias("hit"))
    return best.select(
        *[F.col("kept")[f"k{i}"].alias(c) for i, c in enumerate(keep)], "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    )
