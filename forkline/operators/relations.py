"""Joins over names, paths, boxes and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forkline.functions.text import is_placeholder, path_prefixes
from forkline.session import materialised, partitions

#: Members of a class that are multiplied out at once: Spark holds all pairs that one row gives.
PACK = 500


def longest_prefix(rows: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """Each row with the longest root (column root) that is its path or a directory above it; root null if none is.

    Prefixes of each distinct path are exploded and met by an equi-join; no pair of row and root is compared.
    """
    steps = rows.select(path).distinct().select(path, F.explode(path_prefixes(F.col(path))).alias("root"))
    found = steps.join(roots.select("root").distinct(), "root").groupBy(path).agg(F.max_by("root", F.length("root")).alias("root"))
    return rows.join(found, path, "left").select(*rows.columns, "root")


def minimal_dirs(dirs: DataFrame) -> DataFrame:
    """Directories (dir) that lie under no other of the table; the empty one is above all."""
    distinct = dirs.select("dir").distinct()
    above = F.slice(path_prefixes(F.col("dir")), 1, F.greatest(F.size(path_prefixes(F.col("dir"))) - 1, F.lit(0)))
    under = distinct.where("dir <> ''").select("dir", F.explode(F.concat(above, F.array(F.lit("")))).alias("top"))
    nested = under.join(distinct.select(F.col("dir").alias("top")), "top", "left_semi").select("dir")
    return distinct.join(nested, "dir", "left_anti")


def drop_ancestors(dirs: DataFrame) -> DataFrame:
    """Directories (dir) that have no other of the table under them."""
    distinct = dirs.select("dir").distinct()
    prefixes = path_prefixes(F.col("dir"))
    tops = distinct.where("dir <> ''").select(F.explode(F.concat(F.slice(prefixes, 1, F.greatest(F.size(prefixes) - 1, F.lit(0))), F.array(F.lit("")))).alias("dir"))
    return distinct.join(tops.distinct(), "dir", "left_anti")


def _segments_match(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: (x == y) | is_placeholder(x) | is_placeholder(y))
    return (F.size(a) == F.size(b)) & F.forall(same, lambda s: s)


def _end(segments: Column, route: bool, place: int) -> Column:
    """Keys by the segment at ``place``: a call and a route whose segments there match have exactly one in common, others none.

    A literal of a call meets the same literal or any placeholder of a route; a placeholder of a call meets whatever a route has.
    """
    word = F.coalesce(F.try_element_at(segments, F.lit(place)), F.lit(""))
    literal = F.concat(F.lit("="), word)
    if route:
        return F.array(F.when(is_placeholder(word), F.lit("*")).otherwise(literal), F.lit("?"))
    return F.when(is_placeholder(word), F.array(F.lit("?"))).otherwise(F.array(literal, F.lit("*")))


def route_match(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """The route each call (call_id, method, segments) names: call_id, route, confidence.

    A unique route whose segments all match (placeholders match anything) is ``resolved``; else a unique one whose last
    segments the call's match, or the other way round, is ``inferred``; more than one at a tier names none.  Calls and routes meet by
    method, number of segments, first and last segment, or by method and last segment, so that only plausible pairs are compared.
    """
    r = routes.select("route", "method", F.col("segments").alias("route_segments"))

    def keyed(rows: DataFrame, segments: str, route: bool, size: bool) -> DataFrame:
        rows = rows.withColumn("size", F.size(segments) if size else F.lit(0)).withColumn("last", F.explode(_end(F.col(segments), route, -1)))
        return rows.withColumn("first", F.explode(_end(F.col(segments), route, 1))) if size else rows.withColumn("first", F.lit(""))

    def meet(size: bool) -> DataFrame:
        return keyed(calls, "segments", False, size).join(keyed(r, "route_segments", True, size), ["method", "size", "first", "last"])

    full = meet(True).where(_segments_match(F.col("segments"), F.col("route_segments")))
    n = F.least(F.size("segments"), F.size("route_segments"))
    tail = lambda c: F.slice(c, F.size(c) - n + 1, n)
    suffix = meet(False).where((n > 0) & (F.size("segments") != F.size("route_segments")) & _segments_match(tail(F.col("segments")), tail(F.col("route_segments"))))
    unique = lambda df, word: df.groupBy("call_id").agg(F.countDistinct("route").alias("n"), F.min("route").alias("route")).select("call_id", "n", "route", F.lit(word).alias("confidence"))
    first = unique(full, "resolved")
    second = unique(suffix.join(first, "call_id", "left_anti"), "inferred")
    return first.union(second).where("n = 1").drop("n")


def packed(members: DataFrame) -> DataFrame:
    """Members (class, member) in ascending arrays of at most ``PACK``, of which no two of a class overlap: class, pack, members; of two
    packs of a class that with the greater number has the greater members."""
    spark = members.sparkSession
    row = materialised(members.repartitionByRange(partitions(spark), "class", "member").sortWithinPartitions("class", "member").withColumn("row", F.monotonically_increasing_id()))
    # places within a partition, which the upper bits number
    pack = F.struct(F.shiftright("row", 33).alias("part"), F.expr(f"(row & {2**33 - 1}) div {PACK}").alias("pack"))
    return materialised(row.groupBy("class", pack.alias("pack")).agg(F.array_sort(F.collect_list("member")).alias("members")))


def class_pairs(members: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (class, member) of two classes that met (a_class, b_class); a class may meet itself.

    Members are packed into arrays of at most ``PACK``, the arrays of two classes meet, and are dealt out before they are multiplied
    out: pairs themselves are never shuffled, and a large class is no single task.
    """
    packs = packed(members)
    side = lambda c: packs.select(F.col("class").alias(f"{c}_class"), F.col("members").alias(c))
    return _multiplied(met.join(side("a"), "a_class").join(side("b"), "b_class").select("a", "b"))


def member_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct members (class, member) of one class.  Of two packs all of one are less than all of the other, so that
    no pair is made in vain, and what is written repeats itself."""
    packs = packed(members)
    side = lambda c: packs.select("class", F.col("pack").alias(f"{c}_pack"), F.col("members").alias(c))
    across = _multiplied(side("a").join(side("b"), "class").where("a_pack < b_pack").select("a", "b"))
    one = packs.select(F.posexplode("members").alias("place", "a"), "members")
    return across.union(one.select("a", F.explode(F.slice("members", F.col("place") + 2, PACK)).alias("b")))


def _multiplied(facing: DataFrame) -> DataFrame:
    dealt = facing.repartition(8 * partitions(facing.sparkSession))
    return dealt.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))


def subset_join(sets: DataFrame, owner: str, member: str) -> DataFrame:
    """Pairs of owners (small, large) of which the first's members are among the second's.

    sets (owner, member), repetitions are ignored.  Owners of equal sets (they share two 64-bit sums and their size) are a class, of
    which one is tried.  A set is tried only against the owners of its rarest member whose sets are no smaller; the members of each
    pair left are then looked up and counted.
    """
    every = materialised(sets.select(F.col(owner).alias("small"), F.col(member).alias("member")).distinct())
    shape = [F.count("*").alias("size"), F.bit_xor(F.xxhash64("member")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "member")).alias("g")]
    shaped = materialised(every.where("small is not null").groupBy("small").agg(*shape, F.bool_or(F.col("member").isNull()).alias("unsure")))
    first = materialised(shaped.groupBy("size", "h", "g", "unsure").agg(F.min("small").alias("class")))
    classes = shaped.join(first, ["size", "h", "g", "unsure"]).select("class", F.col("small").alias("member"))
    distinct = materialised(every.join(first.select(F.col("class").alias("small")), "small", "left_semi"))
    sizes = distinct.groupBy("small").agg(F.count("*").alias("size"))
    owners = distinct.groupBy("member").agg(F.count("*").alias("owners"))
    rarest = distinct.join(owners, "member").groupBy("small").agg(F.min(F.struct("owners", "member")).alias("r")).select("small", F.col("r.member").alias("member"))
    b = distinct.withColumnRenamed("small", "large")
    tried = rarest.join(sizes, "small").join(b.join(sizes.toDF("large", "large_size"), "large"), "member").where("small <> large and size <= large_size").select("small", "large", "size")
    shared = tried.join(distinct, "small").join(b, ["large", "member"], "left_semi").groupBy("small", "large", "size").agg(F.count("*").alias("shared"))
    met = shared.where("shared = size").select(F.col("small").alias("a_class"), F.col("large").alias("b_class"))
    met = met.union(first.where("not unsure").select("class", F.col("class").alias("b_class")))  # a member that is null is among none
    return class_pairs(classes, materialised(met)).where("a <> b").toDF("small", "large")


def rect_overlap(boxes: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (id, x0, y0, x1, y1) that overlap strictly on both axes: a < b.

    Equal boxes are a class.  Classes are put into the grid cells they touch and meet there; a pair is reported in the cell of its
    overlap's lower corner, so once.
    """
    sides = ["x0", "y0", "x1", "y1"]
    numbered = materialised(boxes.select(*sides).distinct().withColumn("class", F.monotonically_increasing_id()))
    members = boxes.join(numbered, sides).select("class", F.col("id").alias("member"))
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    placed = numbered.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))
    a, b = placed.alias("a"), placed.alias("b")
    met = a.join(b, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.class") < F.col("b.class")))
    over = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    corner = (F.floor(F.greatest("a.x0", "b.x0") / cell) == F.col("a.cx")) & (F.floor(F.greatest("a.y0", "b.y0") / cell) == F.col("a.cy"))
    apart = met.where(over & corner).select(F.col("a.class").alias("a_class"), F.col("b.class").alias("b_class"))
    own = numbered.where("x0 < x1 and y0 < y1").select(F.col("class").alias("a_class"), F.col("class").alias("b_class"))
    across = class_pairs(members, materialised(apart)).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return across.union(class_pairs(members, materialised(own)).where("a < b"))  # within a class both orders come


def overlay(base: DataFrame, key: str, overrides: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """Base rows without the deleted keys, with values of ``overrides`` where given, and the added rows whose key is new."""
    values = [c for c in base.columns if c != key]
    new = overrides.select(key, *[F.col(c).alias(f"new_{c}") for c in overrides.columns if c != key])
    kept = base.join(deleted.select(key), key, "left_anti").join(new, key, "left")
    kept = kept.select(key, *[F.coalesce(f"new_{c}", c).alias(c) if f"new_{c}" in new.columns else F.col(c) for c in values])
    return kept.unionByName(added.select(base.columns).join(base.select(key), key, "left_anti"))


def owner_index(rows: DataFrame, owner: str, entry: str) -> DataFrame:
    """Sorted distinct entries of each owner, and how many: owner, entries (array), n."""
    return rows.groupBy(owner).agg(F.array_sort(F.collect_set(entry)).alias("entries")).withColumn("n", F.size("entries"))


def dominant(rows: DataFrame, group: str, value: str, share: float = 0.8) -> DataFrame:
    """The value that makes up at least ``share`` of a group's rows: group, value, n, total."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))
    return counts.withColumn("total", total).withColumn("rank", rank).where((F.col("rank") == 1) & (F.col("n") >= share * F.col("total"))).drop("rank")


def dedupe_by_key(rows: DataFrame, keys: list[str], ident: str, weight: str) -> DataFrame:
    """One row for each key: least id, summed weight."""
    return rows.groupBy(*keys).agg(F.min(ident).alias(ident), F.sum(weight).alias(weight))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], changed: str) -> DataFrame:
    """``table`` with ``rows`` put in by key: a row replaces that of its key if column ``changed`` differs, and new keys are added."""
    new = rows.select(*keys, F.col(changed).alias("new_value"))
    same = table.join(new, keys).where(F.col(changed).eqNullSafe(F.col("new_value"))).select(*keys)
    news = rows.join(same, keys, "left_anti")
    return table.join(news.select(*keys), keys, "left_anti").unionByName(news)
