"""Mixing sources to target weights by hash thresholds.

Each document has a hash.  A source takes whole copies of all its documents as often as they fit into its target, and once more
those whose hash is below a threshold.  Thresholds are found from histograms: sizes are summed by source and by the upper bits
of the hash; the running sum of a source's buckets tells in which bucket its budget ends; only the documents of that bucket are
looked at again, by the next bits, until a bucket is one document.  Nothing is sorted but the buckets of a source, and a
smaller budget takes some of the documents that a larger one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forkline.llm.skew import hot_join
from forkline.session import materialised, partitions

#: Bits by which each histogram divides what the one before has left; they divide those of a hash, the upper ones of a SHA-256.
BITS, HASH_BITS = 12, 60
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows``, one for each key, with their place (long, from 0) by the order of keys: sorted in ranges, of which only the sizes meet."""
    part = f"{name}_part"
    spark = rows.sparkSession
    dealt = materialised(rows.repartitionByRange(partitions(spark), key).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count("*").alias("size"))  # as many rows as ranges
    before = sizes.select(part, (F.sum("size").over(Window.orderBy(part)) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy(part).orderBy(key)) - 1
    return dealt.withColumn(name, place.cast("long")).join(F.broadcast(before), part).withColumn(name, F.col(name) + F.col("before")).drop(part, "before")


def targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sources`` (key, source_size) with ``target``: its share of all sizes by weight, at most ``most`` times its size.

    Sources in the order of their keys have the weights in turn.  What a source at its limit leaves is shared by weight among
    the others until none is above its own limit: the level, words for each unit of weight, only rises, and a source at
    its limit stays there, so that the rounds end when no further one gets there.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    own = materialised(numbered(sources, "key", "place").withColumn("weight", weight).drop("place"))
    limit = F.col("source_size").cast("double") * most
    level, full = 0.0, -1
    while True:
        at_limit = F.col("weight") * level > limit if full >= 0 else F.lit(False)
        total, capped, free, now = own.agg(
            F.sum("source_size"), F.sum(F.when(at_limit, F.col("source_size")).otherwise(0)), F.sum(F.when(at_limit, 0.0).otherwise(F.col("weight"))), F.count_if(at_limit)
        ).first()
        if now == full or not free:
            break
        level, full = (total - most * capped) / free, now
    return own.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), limit)).drop("weight")


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", bits: int = BITS) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target (of its source), copies, taken (copies times size).

    size is the number of words; null texts have none.  Null is a source of its own, after all others.  A source's documents
    are taken ``target // source_size`` times, and once more in the order of their hashes (of doc_id and text) while that
    brings what is taken nearer to the target; so it misses by half a document at most, the one at which it ends.  Rows with
    one doc_id and one text have one hash; of these as many as fit are taken, and since they are equal it does not matter
    which.  Documents without words, and all if no text has words, are taken ``target // source_size`` times as well (0 times
    if the source has no words).  Reruns agree.  An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    key = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))
    named = F.concat(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    own = F.conv(F.substring(F.sha2(named, 256), 1, HASH_BITS // 4), 16, 10).cast("long")
    salt = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("key"), words(F.col(text)).alias("size"), own.alias("hash"), salt.alias("salt"))
    rows = materialised(rows)
    sources = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    facts = targets(materialised(sources), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    facts = facts.withColumn("whole", F.least(ratio, F.lit(most)))
    facts = materialised(facts.withColumn("budget", F.when(F.col("whole") < most, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)))
    total = rows.count()
    ends = _thresholds(rows, facts.where("budget > 0"), bits, total)
    facts = materialised(facts.join(ends, "key", "left"))
    below = (F.col("hash") < F.col("end_hash")) | ((F.col("hash") == F.col("end_hash")) & (F.col("salt") <= F.col("end_salt")))
    copies = F.col("whole") + F.coalesce(below, F.lit(False)).cast("long")
    out = hot_join(rows, facts, ["key"], "rows", total).withColumn("copies", copies)
    name = F.when(F.col("key") != "1", F.substring(F.col("key"), 2, 1 << 30))
    return out.select("doc_id", name.alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _thresholds(rows: DataFrame, facts: DataFrame, bits: int, total: int) -> DataFrame:
    """The last (hash, salt) that each source of ``facts`` (key, budget, rows) takes once more: key, end_hash, end_salt.

    Sources that take none have no row.  Rounds end when each source's last bucket is one row; rows of equal hash are told
    apart by the salt, of which rounds are as many again.
    """
    digits = [(c, HASH_BITS - bits * (k + 1)) for c in ("hash", "salt") for k in range(HASH_BITS // bits)]
    left = rows.select("key", "size", "hash", "salt")
    open_ = facts.select("key", "budget", "rows")
    count = total
    ended: list[DataFrame] = []
    for c, shift in digits:
        bucket = F.shiftright(F.col(c), shift).bitwiseAND((1 << bits) - 1).alias("bucket")
        sums = left.groupBy("key", bucket).agg(F.sum("size").alias("sum"), F.count("*").alias("n"), F.max(F.struct("hash", "salt")).alias("last"))
        order = Window.partitionBy("key").orderBy("bucket")  # at most 2 ** bits rows a source
        run = sums.join(open_.select("key", "budget"), "key").withColumn("upto", F.sum("sum").over(order)).withColumn("next", F.lead("bucket").over(order))
        # The first bucket in which the running sum passes the budget; the last one of all where rounding keeps it from that.
        hit = run.where("(upto > budget and upto - sum <= budget) or (next is null and upto <= budget)")
        hit = hit.groupBy("key").agg(F.min(F.struct("bucket", (F.col("budget") - F.col("upto") + F.col("sum")).alias("budget"), "sum", "n", "last")).alias("hit"))
        hit = materialised(hit.select("key", "hit.*"))
        single = F.col("n") == 1
        # One row is left: it is taken if that is nearer.  If not, the end is just before it.
        near = F.col("sum") - F.col("budget") <= F.col("budget")
        one = hit.where(single).select("key", F.col("last.hash").alias("end_hash"), (F.col("last.salt") - F.when(near, 0).otherwise(1)).alias("end_salt"))
        ended.append(one)
        open_ = hit.where(~single).select("key", "bucket", "budget", F.col("n").alias("rows"))
        again = open_.agg(F.count("*"), F.sum("rows")).first()
        if not again[0]:
            break
        met = hot_join(left.withColumn("bucket", bucket), facts.select("key", F.col("rows").alias("all")).join(open_.select("key", F.col("bucket").alias("hit")), "key"), ["key"], "all", max(count, 1))
        left = materialised(met.where("bucket = hit").select("key", "size", "hash", "salt"))
        facts = open_.select("key", "rows")
        count = again[1]
    else:
        last = hit.where(~single)
        ended.append(last.select("key", F.col("last.hash").alias("end_hash"), F.col("last.salt").alias("end_salt")))
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out
