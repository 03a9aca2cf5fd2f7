"""Prefix trie of conversations, merged family by family.

Conversations with one base id are a family; each is rebuilt from the first turns of its base and its own later ones.  A
cogroup by family rebuilds them and makes the family's small trie; only its combined nodes are shuffled, and nodes of equal
prefixes are merged over all families.  A node is known by its depth and 128 bits that the hashes of its turns, each mixed
with its depth, add up to; texts never leave the task that reads them.

Nothing is walked level by level.  Of the members of a node the least owns it, and owns what lies below it on its own path.
So a second cogroup hands each family, for each of its conversations, the depth from which on it owns its path and whether
that path ends in a childless node; families sum both over their own subtrees, and the sums are merged like the nodes.

A family has few conversations, but one of these may be of any length.  Turns are dealt in ranges of (base, conversation,
turn), so that a family whose rows fill several ranges is several groups.  In each of these but the first at most one
conversation goes on from the range before; its path in the range is open until the sums of the ranges before are known,
of which there are no more than there are ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forkline.llm.hashing import mix
from forkline.llm.memory import tidy
from forkline.llm.skew import hot_join
from forkline.session import materialised, partitions, ship

#: Rows of a range; bounds what a task of a cogroup holds.
ROWS = 100_000
#: Ids of a family; a conversation takes fewer than HEADS turns of its base.
FAMILY, HEADS = 100, 6
EMPTY = hashlib.sha256(b"").hexdigest()

KEY = ["depth", "f1", "f2"]
NODES = (
    "base long, part int, conv_id long, open boolean, depth long, f1 long, f2 long, p1 long, p2 long, chars long, n long, "
    "ends array<long>, goes long, pre int, size int"
)
SUMS = "depth long, f1 long, f2 long, n_leaves long, saved_tokens long"
ENDS = "depth long, f1 long, f2 long, ends_sha256 string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (f.split(" ") for f in text.split(", "))])


_NODES, _SUMS, _ENDS = _schema(NODES), _schema(SUMS), _schema(ENDS)


def _salted(h: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Hash of a turn at a depth; prefixes add (xor) these up."""
    return mix(h.view(np.uint64) ^ mix(depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


@dataclass
class _Node:
    conv: int  # the least conversation that reaches it
    key: tuple[int, ...]
    parent: int
    chars: int
    n: int = 0
    ends: list[int] = field(default_factory=list)
    goes: int | None = None  # the conversation that goes on from here in a later range


class _Trie:
    """The trie of a group of rows, or a forest, if a conversation goes on from an earlier range; parents come before children."""

    def __init__(self) -> None:
        self.at: dict[tuple[int, ...], int] = {}
        self.nodes: list[_Node] = []

    def reach(self, key: tuple[int, ...], parent: int, conv: int, chars: int) -> int:
        found = self.at.get(key)
        if found is None:
            found = self.at[key] = len(self.nodes)
            self.nodes.append(_Node(conv, key, parent, chars))
        return found

    def order(self) -> tuple[list[int], list[int]]:
        """The place of each node where its subtree follows it at once, and the size of its subtree."""
        size, place, free = [1] * len(self.nodes), [0] * len(self.nodes), [0] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):
            if (up := self.nodes[k].parent) >= 0:
                size[up] += size[k]
        roots = 0
        for k, node in enumerate(self.nodes):
            if node.parent < 0:
                place[k], roots = roots, roots + size[k]
            else:
                place[k] = free[node.parent]
                free[node.parent] += size[k]
            free[k] = place[k] + 1
        return place, size


def _built(turns: pa.Table, pieces: pa.Table) -> pa.Table:
    """Nodes of one group: its turns (conv_id, turn, h1, h2, chars) and what is known of its conversations' pieces.

    pieces: base, part, conv_id, before (own turns in earlier ranges), last (no later range has some), take (turns of its base
    that begin it) and the base's first turns (head: h1, h2, chars).
    """
    if not pieces.num_rows:
        return _NODES.empty_table()
    null = turns.column("turn").is_null().to_numpy()
    conv, turn, h1, h2, chars = (turns.column(c).fill_null(0).to_numpy() for c in ("conv_id", "turn", "h1", "h2", "chars"))
    order = np.lexsort((h2, h1, turn, ~null, conv))
    conv, h1, h2, chars = conv[order], h1[order], h2[order], chars[order]
    trie = _Trie()
    rows = sorted(pieces.to_pylist(), key=lambda r: r["conv_id"])
    for r in rows:
        c, before, take = r["conv_id"], r["before"], r["take"]
        lo, hi = np.searchsorted(conv, c, "left"), np.searchsorted(conv, c, "right")
        lo = min(hi, lo + max(0, take - before))
        head = [(x["h1"], x["h2"], x["chars"]) for x in (r["head"] or [])[:take]]
        depth = len(head) + max(0, before - take) if before else 0
        own = np.stack((h1[lo:hi], h2[lo:hi], chars[lo:hi]))
        if head and not before:
            own = np.concatenate((np.array(head, dtype=np.int64).T, own), axis=1)
        depths = np.arange(depth + 1, depth + 1 + own.shape[1])
        f1, f2 = (np.bitwise_xor.accumulate(_salted(h, depths)).view(np.int64).tolist() for h in own[:2])
        tag = (c,) if before else ()  # an open path is one of its own
        at = trie.reach((depth, 0, 0, *tag), -1, c, 0)
        trie.nodes[at].n += not before  # else an earlier range counts it
        for d, a, b, size in zip(depths.tolist(), f1, f2, own[2].tolist()):
            at = trie.reach((d, a, b, *tag), at, c, size)
            trie.nodes[at].n += 1
        if r["last"]:
            trie.nodes[at].ends.append(c)
        else:
            trie.nodes[at].goes = c
    place, size = trie.order()
    base, part = rows[0]["base"], rows[0]["part"]
    up = [trie.nodes[x.parent].key[1:3] if x.parent >= 0 else (None, None) for x in trie.nodes]
    out = [(base, part, x.conv, len(x.key) > 3, *x.key[:3], *p, x.chars, x.n, x.ends, x.goes, at, s) for x, p, at, s in zip(trie.nodes, up, place, size)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NODES)], schema=_NODES)


def _summed(nodes: pa.Table, owners: pa.Table) -> pa.Table:
    """Sums over the subtrees of one group's nodes.

    owners: conv_id, own (depth from which on it owns its path; null: nowhere), leaf (depth of the childless node that it owns and
    ends in; null: none), more_leaves and more_saved (of its later ranges).
    """
    if not nodes.num_rows:
        return _SUMS.empty_table()
    nodes = nodes.sort_by("pre")
    known = {r["conv_id"]: r for r in owners.to_pylist()}
    conv, goes = nodes.column("conv_id").to_pylist(), nodes.column("goes").to_pylist()
    depth, n, chars, size = (nodes.column(x).to_numpy() for x in ("depth", "n", "chars", "size"))
    far = np.iinfo(np.int64).max
    own = np.array([far if (x := known[c]["own"]) is None else x for c in conv], dtype=np.int64)
    leaf = np.array([-1 if (x := known[c]["leaf"]) is None else x for c in conv], dtype=np.int64)
    owned = (own <= depth) & (n > 0)
    leaves, saved = (owned & (leaf == depth)).astype(np.int64), chars * (n - owned)
    for k, c in enumerate(goes):
        if c is not None:  # what follows in later ranges hangs below
            leaves[k] += known[c]["more_leaves"] or 0
            saved[k] += known[c]["more_saved"] or 0
    at = np.arange(len(conv))
    sums = [(total := np.concatenate(([0], np.cumsum(x))))[at + size] - total[at] for x in (leaves, saved)]
    out = pa.Table.from_arrays([*(nodes.column(k) for k in KEY), *(pa.array(x) for x in sums)], schema=_SUMS)
    return out.filter(pa.array(n > 0))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, ends): the SHA-256 of all ends of a key, as decimals joined by commas, row after row."""
    key, state = None, None
    for part in batches:
        for *now, ends in zip(*(c.to_pylist() for c in part.columns)):
            text = ",".join(map(str, ends))
            if now == key:
                state.update(b",")
            else:
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*key, state.hexdigest()), _ENDS)], schema=_ENDS)
                key, state = now, hashlib.sha256()
            state.update(text.encode())
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*key, state.hexdigest()), _ENDS)], schema=_ENDS)


def prefix_trie(conversations: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c (c - c % 100 is its base, h the unsigned crc32 of its decimal modulo 6) is rebuilt as the first h turns of its
    base, all if there are fewer, and its own turns after its first h.  A node is a sequence of turns (role, text) with which
    rebuilt conversations, its members, begin; the root is the empty one, of which all are members.  conv_id is the least member,
    parent_conv_id that of the node without its last turn; n_leaves counts childless nodes of the subtree, the node included;
    saved_tokens adds up, over the subtree, code points of a node's last text times its members but one; ends_sha256 is that of
    the decimals of the members that are no longer than the node, ascending, joined by commas.

    Turns are ordered by turn, null first; those of one turn by a hash of role and text, so that repeated rows, which are turns of
    their own, and ties do not depend on the order of rows.  Null roles and texts are empty ones.  Rows without conv_id take no part.  An
    empty table has no members, hence no nodes; other columns are not read.  Prefixes are told apart by 128 bits.
    """
    spark = conversations.sparkSession
    ship(spark)
    c = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    turns = conversations.where(c.isNotNull()).select(
        (c - c % FAMILY).alias("base"), c.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(2), text, role).alias("h2"),
        F.length(text).cast("long").alias("chars"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    ranges = max(partitions(spark), -(-conversations.count() // rows))
    dealt = turns.repartitionByRange(ranges, "base", "conv_id", "turn", "h1", "h2", "salt")
    dealt = materialised(dealt.drop("salt").withColumn("part", F.spark_partition_id()))
    nodes, pieces = _nodes(dealt)
    merged = materialised(
        nodes.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min((F.col("size") == 1) & F.col("goes").isNull()).alias("childless")
        )
    )
    path = F.min(F.struct("depth", "p1", "p2", "f1", "f2")).alias("path")
    owners = materialised(merged.groupBy("conv_id").agg(path, F.max(F.when(F.col("childless"), F.col("depth"))).alias("leaf")))
    return _assembled(nodes, merged, owners, _sums(nodes, pieces, owners))


def _nodes(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of all groups, open paths resolved, and the pieces of the conversations."""
    by_part = Window.partitionBy("conv_id").orderBy("part")
    sizes = dealt.groupBy("base", "conv_id", "part").agg(F.count("*").alias("own"))
    sizes = sizes.withColumn("before", F.sum("own").over(by_part) - F.col("own")).withColumn("last", F.lead("part").over(by_part).isNull())
    place = F.row_number().over(Window.partitionBy("base").orderBy("turn", "h1", "h2"))
    first = dealt.where("conv_id = base").withColumn("place", place).where(F.col("place") < HEADS)
    heads = first.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("place", "h1", "h2", "chars"))).alias("head"))
    take = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int").alias("take")
    pieces = materialised(sizes.join(heads, "base", "left").select("base", "part", "conv_id", "before", "last", take, "head"))
    built = lambda left, right: _built(left, right)
    nodes = materialised(dealt.groupBy("base", "part").cogroup(pieces.groupBy("base", "part")).applyInArrow(built, NODES))
    split = pieces.where("before > 0 or not last").select("conv_id", "part", "before")
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    ends = nodes.where("goes is not null").select(F.col("goes").alias("conv_id"), "part", "f1", "f2")
    starts = split.join(ends, ["conv_id", "part"], "left").select("conv_id", "part", "before", *[F.bit_xor(f).over(earlier).alias(s) for f, s in (("f1", "s1"), ("f2", "s2"))]).where("before > 0")
    moved = {f: F.col(f).bitwiseXOR(F.col(s)).alias(f) for f, s in (("f1", "s1"), ("f2", "s2"), ("p1", "s1"), ("p2", "s2"))}
    going_on = nodes.where("open").join(starts.drop("before"), ["conv_id", "part"]).select(*[moved.get(x, F.col(x)) for x in nodes.columns])
    return materialised(nodes.where("not open").unionByName(going_on)), pieces


def _sums(nodes: DataFrame, pieces: DataFrame, owners: DataFrame) -> DataFrame:
    """Leaves and savings of the subtrees of all groups' nodes: columns of SUMS."""
    own = F.col("path.depth").alias("own")
    open_ = nodes.where("open and n > 0")
    counted = open_.groupBy("conv_id").agg(F.count("*").alias("rows"))
    facts = materialised(counted.join(owners.select("conv_id", own, "leaf"), "conv_id", "left"))
    met = hot_join(open_.select("conv_id", "part", "depth", "chars"), facts, ["conv_id"], "rows")
    totals = met.groupBy("conv_id", "part").agg(F.sum(F.when(F.coalesce(F.col("own") <= F.col("depth"), F.lit(False)), 0).otherwise(F.col("chars"))).alias("saved"), F.count_if(F.col("leaf") == F.col("depth")).alias("leaves"))
    later = Window.partitionBy("conv_id").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    more = pieces.where("before > 0 or not last").select("conv_id", "part").join(totals, ["conv_id", "part"], "left").select("conv_id", "part", F.sum("saved").over(later).alias("more_saved"), F.sum("leaves").over(later).alias("more_leaves"))
    facts = pieces.select("base", "part", "conv_id").join(owners.select("conv_id", own, "leaf"), "conv_id", "left").join(more, ["conv_id", "part"], "left")
    summed = lambda left, right: _summed(left, right)
    left = nodes.select("base", "part", "conv_id", "pre", "size", *KEY, "chars", "n", "goes")
    return left.groupBy("base", "part").cogroup(facts.groupBy("base", "part")).applyInArrow(summed, SUMS)


def _assembled(nodes: DataFrame, merged: DataFrame, owners: DataFrame, sums: DataFrame) -> DataFrame:
    """What families and merged nodes say of a node meets by its key, added up before it is shuffled."""
    up = owners.where("path.depth > 0").select("conv_id", (F.col("path.depth") - 1).alias("depth"), F.col("path.p1").alias("f1"), F.col("path.p2").alias("f2"), F.col("path.f1").alias("g1"), F.col("path.f2").alias("g2"))
    asked = up.groupBy(*KEY).agg(F.count("*").alias("rows"))
    above = materialised(asked.join(merged.select(*KEY, F.col("conv_id").alias("parent_conv_id")), KEY))
    parents = hot_join(up, above, KEY, "rows").select((F.col("depth") + 1).alias("depth"), F.col("g1").alias("f1"), F.col("g2").alias("f2"), "parent_conv_id")
    children = merged.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"), F.lit(1).cast("long").alias("n_children"))
    ends = nodes.where(F.size("ends") > 0).select(*KEY, "ends").repartition(*KEY).sortWithinPartitions(*KEY, F.col("ends")[0]).mapInArrow(tidy(_hashed), ENDS)
    parts = merged.select(*KEY, "conv_id", "n_convs")
    for more in (sums, children, parents, ends):
        parts = parts.unionByName(more, allowMissingColumns=True)
    found = parts.groupBy(*KEY).agg(
        F.max("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent"), F.max("n_convs").alias("n_convs"), F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.coalesce(F.max("ends_sha256"), F.lit(EMPTY)).alias("ends_sha256"),
    )
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id")
    return found.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
