"""Verdicts, scores, budgets and top-k choices as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arm_class(terminal: Column, reach: Column) -> Column:
    """guard (leaves early and reaches at most two), void (reaches nothing) or live; guard is tested first."""
    return F.when(terminal.isin("raises", "returns", "continues") & (reach <= 2), "guard").when(reach == 0, "void").otherwise("live")


def site_verdicts(arms: DataFrame) -> DataFrame:
    """Verdict of each site from its arms (site, kind, idx, terminal, reach: sorted array): site, kind, arms, live, verdict.

    Routes, tables, polymorphic and dynamic sites are decisions with two arms or more; others with two live arms or more of
    which none reaches a subset of another's; a single live arm besides a guard makes a guarded step; the rest is noise.
    """
    classed = arms.withColumn("class", arm_class(F.col("terminal"), F.size("reach")))
    live = F.collect_list(F.when(F.col("class") == "live", F.col("reach")))
    sites = classed.groupBy("site", "kind").agg(
        F.count("*").alias("arms"), F.count_if(F.col("class") == "live").alias("live"), F.count_if(F.col("class") == "guard").alias("guards"), live.alias("sets")
    )
    indexes = F.when(F.size("sets") > 1, F.sequence(F.lit(0), F.size("sets") - 1)).otherwise(F.array().cast("array<int>"))
    inside = F.exists(indexes, lambda i: F.exists(indexes, lambda j: (i != j) & (F.size(F.array_except(F.get("sets", i), F.get("sets", j))) == 0)))
    verdict = (
        F.when(F.col("kind").isin("route", "table", "polymorphic", "dynamic"), F.when(F.col("arms") >= 2, "decision").otherwise("noise"))
        .when((F.col("live") >= 2) & ~inside, "decision")
        .when((F.col("live") == 1) & (F.col("guards") >= 1), "guarded_step")
        .otherwise("noise")
    )
    return sites.select("site", "kind", "arms", "live", verdict.alias("verdict"))


def site_score(reach: Column, provenance: Column, reconverges: Column, kind: Column) -> Column:
    """3 log2(1 + distinct live reach) + 2 provenance + 2 if paths do not meet again + 1 for kinds that dispatch."""
    return 3 * F.log2(1 + reach) + 2 * provenance + F.when(reconverges, 0).otherwise(2) + F.when(kind.isin("route", "table", "polymorphic"), 1).otherwise(0)


def top_k(rows: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` of each group; Spark keeps k rows a group on either side of the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= k)


def fold_top_k(arms: DataFrame, group: str, member: str, weight: str, most: int = 5) -> DataFrame:
    """Groups of more than ``most`` members keep ``most`` - 1 by (-weight, member); the rest is one row ``fold:<group>``.

    Columns group, member (string), folded (members behind the row).
    """
    ranked = arms.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(weight), member)))
    sized = ranked.join(arms.groupBy(group).agg(F.count("*").alias("n")), group)
    folds = (F.col("n") > most) & (F.col("rn") >= most)
    named = sized.select(group, F.when(folds, F.concat(F.lit("fold:"), F.col(group).cast("string"))).otherwise(F.col(member).cast("string")).alias("member"))
    return named.groupBy(group, "member").agg(F.count("*").alias("folded"))


def apportion(lanes: DataFrame, lane: str, mass: str, total: int = 40, least: int = 3) -> DataFrame:
    """Budget of each lane: floor of its share of ``total``, what is left one each to the heaviest, then ``least`` at least.

    Without any mass all lanes have an even floor share.  Sums are scalar subqueries.
    """
    shared = lanes.withColumns({"all_mass": lanes.agg(F.sum(mass)).scalar(), "lanes_n": lanes.agg(F.count("*")).scalar()})
    base = F.when(F.col("all_mass") > 0, F.floor(F.lit(total) * F.col(mass) / F.col("all_mass"))).otherwise(F.floor(F.lit(total) / F.col("lanes_n")))
    based = shared.withColumn("base", base)
    ranked = based.withColumns({"left_over": based.agg(F.lit(total) - F.sum("base")).scalar(), "rn": F.row_number().over(Window.orderBy(F.desc(mass), lane))})  # lanes are tens
    extra = F.when((F.col("all_mass") > 0) & (F.col("rn") <= F.col("left_over")), 1).otherwise(0)
    return ranked.select(lane, mass, F.greatest(F.lit(least), F.col("base") + extra).cast("long").alias("budget"))


def fair_demotion(nodes: DataFrame, lane: str, strength: str, node: str, excess: int) -> DataFrame:
    """The ``excess`` nodes that go when again and again the largest lane (then greatest name) loses its weakest node.

    A node goes when its lane has as many nodes as it has rank from the strongest; so the greedy takes the nodes of greatest
    (rank, lane), which is a sort with a limit.
    """
    rank = F.row_number().over(Window.partitionBy(lane).orderBy(F.desc(strength), node))
    return nodes.withColumn("size_at_removal", rank).orderBy(F.desc("size_at_removal"), F.desc(lane)).limit(excess)


def reveal_chunks(members: DataFrame, owner: str, order: list[Column], most: int = 8) -> DataFrame:
    """Number of the chunk of each member: up to ``most`` members are one chunk, else chunks of ``most`` - 1, the last of up to ``most``."""
    ranked = members.withColumn("rn", F.row_number().over(Window.partitionBy(owner).orderBy(*order)))
    sized = ranked.join(members.groupBy(owner).agg(F.count("*").alias("n")), owner)
    step = most - 1
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - most) / step))  # chunks before the last
    return sized.withColumn("chunk", F.least(F.floor((F.col("rn") - 1) / step), last).cast("long")).drop("rn", "n")


def sequence_chain(rows: DataFrame, group: str, order: list[Column], breaks: Column) -> DataFrame:
    """Gaps and islands: number of the run of each row in its group; a new run starts where ``breaks`` holds (null: does not)."""
    window = Window.partitionBy(group).orderBy(*order)
    marked = rows.withColumn("starts", F.coalesce(breaks.cast("int"), F.lit(0)))
    return marked.withColumn("run", F.sum("starts").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("starts")


def percentile_threshold(counts: DataFrame, column: str, least: int = 8, share: float = 0.9) -> DataFrame:
    """One row: the greater of ``least`` and the nearest-rank percentile."""
    return counts.agg(F.greatest(F.lit(least).cast("double"), F.expr(f"percentile_disc({share}) within group (order by {column})").cast("double")).alias("threshold"))


def utility_fan_in(calls: DataFrame, least: int = 8, share: float = 0.9) -> DataFrame:
    """Components (dst) that many distinct callers of other components call: dst, fan_in, utility; calls (caller, src, dst)."""
    fan_in = calls.where("src <> dst").groupBy("dst").agg(F.countDistinct("caller").alias("fan_in"))
    return fan_in.select("dst", "fan_in", (F.col("fan_in") >= percentile_threshold(fan_in, "fan_in", least, share).scalar()).alias("utility"))
