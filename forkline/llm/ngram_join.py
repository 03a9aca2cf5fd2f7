"""N-gram Jaccard join: prefix filter, prefix trees, components of the links.

1.  Every document becomes the set of 64-bit hashes of its word shingles.  Documents with equal sets are one class.
2.  Shingles are counted in Spark.  Those of one set only cannot be shared and are dropped, but count in the set's size.
    Shingles that the very same sets hold (those of a passage, or of a family of copies) become one token, which weighs
    as many shingles as it stands for.  Tokens get one global order, rare before frequent.
3.  Two sets can reach the threshold only if the first token that they share leaves each of them weight enough: sets
    meet in the groups of such first tokens.
4.  Candidates of one set are stored in a prefix tree over the global order (frequent first, where near copies share
    most).  It is traversed once; partial overlaps are shared by all below a node, and a subtree goes when the
    overlap so far and what can remain fall short of what its smallest set needs.
5.  Links connect classes; components give the least document that each can reach.

Skew: groups are not turned into all their pairs.  In a first round each group tests one pivot against the rest, in a
second about ``PIVOTS`` of them, each time leaving out pairs already known to be connected.  What is left lies across
components.  Where at most ``FEW`` members of a group stand outside its prevailing component, they meet the whole group.
A larger group (one shingle common to very many unlike texts) is divided by the second token that two of its members may
share, that by the third and so on: the upper levels of one prefix tree over all sets, dealt over the cluster.  A level
is added only where it leaves at most half of the pairs; so pairs within a group are made in numbers only if the
texts share most of their rare shingles and yet miss the threshold, which no exact join can tell without comparing them.
No candidate that could join two components is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.llm import messages as M
from forkline.llm.components import components
from forkline.llm.hashing import mix, set_fingerprint, shingle_sets, slices
from forkline.llm.memory import tidy
from forkline.llm.skew import hot_join
from forkline.session import materialised, partitions, ship

U64 = np.uint64
PIVOTS = 16
#: Members outside the prevailing component of a group that meet the whole group.
FEW = 64
#: Candidates of one set that share a tree.
TREE = 64
#: Times that the pairs of a group have to outnumber the entries of one more level, before that is tried.
GAIN = 32
#: Parity bits of a set: two sets differ in as many shingles at least as in bits.
BITS = 512


def required(na: int, nb: int, percent: int) -> int:
    """Least overlap with 100 * overlap >= percent * (na + nb - overlap)."""
    return -(-percent * (na + nb) // (100 + percent))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            size, first, second = [], [], []
            for words in slices(part.column(1)):
                for values in shingle_sets(words, width):
                    size.append(len(values))
                    f, g = set_fingerprint(values) if len(values) else (None, None)
                    first.append(f)
                    second.append(g)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (size, first, second)), part.column(2)], names=["doc_id", "n_shingles", "f1", "f2", "carried"])

    return run


#: Sets that map tasks send are known by slots: task and number in it.  NEAR slots share a home; HELD are sent at once.
NEAR, HELD = 64, 1 << 15
#: Of a shingle's hash so many bits are sent: two sets are compared by them, and two sets have few shingles.
SENT = U64((1 << 48) - 1)


def _home(slots: np.ndarray, buckets: int) -> np.ndarray:
    return (mix((slots // NEAR).view(U64)) % U64(buckets)).astype(np.int64)


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """For each set ``BITS`` bits (rows of 64-bit words), each the parity of the number of its hashes that fall on it."""
    out = np.zeros((len(sets), BITS // 64), dtype=np.int64)
    for at in range(0, len(sets), 512):
        some = sets[at : at + 512]
        which = np.repeat(np.arange(len(some)) * BITS, [len(x) for x in some]) + (np.concatenate(some) & U64(BITS - 1)).astype(np.int64)
        odd = (np.bincount(which, minlength=len(some) * BITS) & 1).astype(bool)
        out[at : at + len(some)] = np.packbits(odd).view(np.int64).reshape(len(some), -1)
    return out


def _send(held: dict[tuple[int, int], np.ndarray], first: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Shingles of some sets, one message a bucket: slots and shingles; and to the homes of the slots what they stand for."""
    sizes = np.array([len(x) for x in held.values()], dtype=np.int64)
    slots = first + np.arange(len(held), dtype=np.int64)
    home = _home(slots, buckets)
    facts = np.column_stack([np.array(list(held), dtype=np.int64), sizes, _bits(list(held.values()))])
    bounds = [(int(lo), int(hi)) for lo, hi in zip(*M.runs(home))]
    yield M.batch([-1 - int(home[lo]) for lo, _ in bounds], [M.pack(slots[lo:hi], facts[lo:hi]) for lo, hi in bounds])
    values, slots = np.concatenate(list(held.values())) & SENT, np.repeat(slots, sizes)
    order, bounds = M.by_bucket(values, buckets)
    low, high, slots = values[order].astype(np.uint32), (values[order] >> U64(32)).astype(np.uint16), slots[order]
    filled = np.flatnonzero(np.diff(bounds)).tolist()
    spans = [slice(bounds[b], bounds[b + 1]) for b in filled]
    yield M.batch(filled, [M.pack(*M.owners(slots[at]), low[at], high[at]) for at in spans])


def _shingles(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        total, first, most = 0, TaskContext.get().partitionId() << 32, M.flush(buckets)
        for part in batches:
            for words in slices(part.column(0)):
                for values in shingle_sets(words, width):
                    if len(values) and (key := set_fingerprint(values)) not in held:
                        held[key] = values
                        total += len(values)
                if total > most or len(held) >= HELD:
                    yield from _send(held, first, buckets)
                    first += len(held)
                    held, total = {}, 0
        if held:
            yield from _send(held, first, buckets)

    return run


def _merged(s: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, tokens and weights in order, the weights of one token of one slot added up."""
    order = np.lexsort((t, s))
    s, t, w = s[order], t[order], w[order]
    starts = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (t[1:] != t[:-1]))))
    return s[starts], t[starts], np.add.reduceat(w, starts)


def _shared(buckets: int):
    """Messages of shingles to messages of tokens, to the homes of their slots.

    A token is a frequency class (upper eight bits) and a sum of hashes of all slots that hold the shingle: shingles of
    the very same slots are one token.  A class that several tasks met counts as often; that raises the class of its
    shingles alike for all and drops nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        passed: list[tuple[int, bytes]] = []

        def group(bucket: int, payloads: list[bytes]) -> None:
            if bucket < 0:
                passed.extend((-1 - bucket, p) for p in payloads)
                return
            slots, values = [], []
            for payload in payloads:
                *who, low, high = M.unpack(payload)
                slots.append(np.repeat(*M.owned(*who)))
                values.append(low | high.astype(U64) << U64(32))
            s, v = np.concatenate(slots), np.concatenate(values)
            del slots, values
            order = np.argsort(v)
            ordered = v[order]
            again = np.zeros(len(v) + 1, dtype=bool)
            again[1:-1] = ordered[1:] == ordered[:-1]
            order = order[again[:-1] | again[1:]]  # in runs of two or more
            s, v = s[order], v[order]
            if not len(v):
                return
            starts, ends = M.runs(v)
            grade = np.minimum(8 * np.log2(ends - starts), 255).astype(U64)
            token = (np.add.reduceat(mix(s.view(U64)), starts) >> U64(8)) | grade << U64(56)
            found.append(_merged(s, np.repeat(token, ends - starts), np.ones(len(s), dtype=np.int64)))

        def send() -> Iterator[pa.RecordBatch]:
            if passed:
                yield M.batch(*map(list, zip(*passed)))
                passed.clear()
            if found:
                s, t, w = _merged(*(np.concatenate(x) for x in zip(*found)))
                found.clear()
                home = _home(s, buckets)
                order = np.argsort(home, kind="stable")
                s, t, w, home = s[order], t[order], w[order], home[order]
                bounds = [(int(lo), int(hi)) for lo, hi in zip(*M.runs(home))]
                yield M.batch([int(home[lo]) for lo, _ in bounds], [M.pack(*M.owners(s[lo:hi]), t[lo:hi], M.shrunk(w[lo:hi])) for lo, hi in bounds])

        most = M.flush(buckets)
        for _ in M.grouped(batches, group):
            if sum(len(x[0]) for x in found) > most or len(passed) > 1000:
                yield from send()
        yield from send()

    return run


#: at: place of each token of the prefix among the set's tokens; skipped: shingles of the set before it in the order.
SETS = "cid long, f1 long, f2 long, n long, bits array<long>, tokens binary, weights binary, prefix array<struct<token:long,at:int,skipped:long>>"
_PREFIX = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int32()), ("skipped", pa.int64())]))
_SETS = pa.schema([(c, pa.int64()) for c in ("cid", "f1", "f2", "n")] + [("bits", pa.list_(pa.int64())), ("tokens", pa.binary()), ("weights", pa.binary()), ("prefix", _PREFIX)])


def _least(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any that it links with."""
    return -(-percent * n // 100)


def _ordered(percent: int):
    """Messages of tokens to ordered sets; sets whose tokens cannot reach the threshold link with nothing and go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def group(_: int, payloads: list[bytes]) -> None:
            known: dict[int, list[int]] = {}
            slots, tokens, weights = [], [], []
            for payload in payloads:
                parts = M.unpack(payload)
                if len(parts) == 2:
                    known.update(zip(parts[0].tolist(), parts[1].reshape(len(parts[0]), -1).tolist()))
                else:
                    slots.append(np.repeat(*M.owned(*parts[:3])))
                    tokens.append(parts[3])
                    weights.append(parts[4].astype(np.int64))
            if not slots:
                return
            s, t, w = _merged(np.concatenate(slots), np.concatenate(tokens), np.concatenate(weights))
            for lo, hi in zip(*M.runs(s)):
                f1, f2, n, *bits = known[int(s[lo])]
                weight = w[lo:hi]
                ends = np.cumsum(weight)
                skipped = n - int(ends[-1]) + ends - weight
                prefix = int(np.searchsorted(skipped, n - _least(n, percent), "right"))
                if prefix:
                    first = [{"token": x, "at": k, "skipped": y} for k, (x, y) in enumerate(zip(t[lo : lo + prefix].view(np.int64).tolist(), skipped[:prefix].tolist()))]
                    rows.append((int(s[lo]), f1, f2, n, bits, t[lo:hi].tobytes(), weight.astype(np.uint32).tobytes(), first))

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), _SETS)], schema=_SETS)
            rows.clear()
            return out

        for _ in M.grouped(batches, group):
            if len(rows) > 2000:
                yield send()
        if rows:
            yield send()

    return run


class PrefixTree:
    """Ordered sets of weighted tokens in a path-compressed trie; a node is a range of the tokens of the set that made it."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], weights: list[np.ndarray] | None = None) -> None:
        self.sets, self.sizes = sets, sizes
        self.tokens = np.concatenate(sets) if sets else np.zeros(0, U64)
        self.weights = np.concatenate(weights).astype(np.int64) if weights else np.ones(len(self.tokens), np.int64)
        self.total = np.concatenate(([0], np.cumsum(self.weights))).tolist()
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64))).tolist()
        # node: [start, end, children by first token, sets that end here, most weight below, least set size below]
        self.root = [0, 0, {}, [], 0, 0]
        for k in range(len(sets)):
            self._insert(k)
        self._bounds()

    def _insert(self, k: int) -> None:
        node, at, end = self.root, self.at[k], self.at[k + 1]
        while True:
            if at == end:
                node[3].append(k)
                return
            first = int(self.tokens[at])
            child = node[2].get(first)
            if child is None:
                node[2][first] = [at, end, {}, [k], 0, 0]
                return
            width = min(child[1] - child[0], end - at)
            differ = np.flatnonzero(self.tokens[child[0] : child[0] + width] != self.tokens[at : at + width])
            same = int(differ[0]) if len(differ) else width
            if same < child[1] - child[0]:
                lower = [child[0] + same, child[1], child[2], child[3], 0, 0]
                child[1], child[2], child[3] = child[0] + same, {int(self.tokens[child[0] + same]): lower}, []
            node, at = child, at + same

    def _bounds(self) -> None:
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(node[2].values())
        for node in reversed(order):
            node[4] = max((c[4] + self.total[c[1]] - self.total[c[0]] for c in node[2].values()), default=0)
            node[5] = min([c[5] for c in node[2].values()] + [self.sizes[k] for k in node[3]], default=0)

    def linked(self, query: np.ndarray, size: int, percent: int, weights: np.ndarray | None = None) -> list[int]:
        """Indexes of the stored sets that reach the threshold with ``query`` (sorted, of ``size`` with what is not shared)."""
        if not len(query):
            return []
        whole = len(query) if weights is None else int(weights.sum())
        spot = np.minimum(np.searchsorted(query, self.tokens), len(query) - 1)
        sums = np.concatenate(([0], np.cumsum((query[spot] == self.tokens) * self.weights))).tolist()
        found, todo = [], [(self.root, 0)]
        while todo:
            node, overlap = todo.pop()
            overlap += sums[node[1]] - sums[node[0]]
            if overlap + min(node[4], whole - overlap) < required(size, node[5], percent):
                continue
            for k in node[3]:
                if overlap >= required(size, self.sizes[k], percent):
                    found.append(k)
            for child in node[2].values():
                todo.append((child, overlap))
        return found


def _trees(percent: int):
    """Rows (a, fan, salt, kind, id, n, tokens, weights) sorted so that the query set (kind 0) precedes its candidates; links come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, query, size, mine, ids, sets, sizes, weights = None, None, 0, None, [], [], [], []

        def links() -> tuple[list[int], list[int]]:
            if not ids or query is None:
                return [], []
            hit = [ids[k] for k in PrefixTree(sets, sizes, weights).linked(query, size, percent, mine)]
            return [key[0]] * len(hit), hit

        for part in batches:
            a, b = [], []
            columns = [part.column(i).to_pylist() for i in range(8)]
            for who, fan, salt, kind, cid, n, tokens, weight in zip(*columns):
                if (who, fan, salt) != key:
                    x, y = links()
                    a += x
                    b += y
                    key, query, ids, sets, sizes, weights = (who, fan, salt), None, [], [], [], []
                values, weight = np.frombuffer(tokens, dtype=U64), np.frombuffer(weight, dtype=np.uint32)
                if kind == 0:
                    query, size, mine = values, n, weight
                else:
                    ids.append(cid)
                    sets.append(values[::-1])
                    weights.append(weight[::-1])
                    sizes.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = links()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, size) that reach the threshold; ``size`` is that of the group where they met.

    The candidates of a set are dealt over a power of two of trees, so that no tree gathers a large group.
    """
    fan = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / TREE))).cast("int").alias("fan")
    pairs = pairs.select("a", "b", fan).groupBy("a", "b").agg(F.max("fan").alias("fan"))
    pairs = materialised(pairs.select("a", "b", "fan", F.expr("pmod(xxhash64(b), shiftleft(1L, fan))").alias("salt")))
    if pairs.isEmpty():
        return pairs.select("a", "b")
    known = sets.select("cid", "n", "tokens", "weights")
    queries = pairs.select("a", "fan", "salt").distinct().join(known, F.col("a") == F.col("cid")).select("a", "fan", "salt", F.lit(0).alias("kind"), "cid", "n", "tokens", "weights")
    others = pairs.join(known, F.col("b") == F.col("cid")).select("a", "fan", "salt", F.lit(1).alias("kind"), "cid", "n", "tokens", "weights")
    rows = queries.union(others).repartition("a", "fan", "salt").sortWithinPartitions("a", "fan", "salt", "kind")
    return materialised(rows.mapInArrow(tidy(_trees(percent)), "a long, b long"))


def _fits(na: Column, sa: Column, nb: Column, sb: Column, percent: int) -> Column:
    """Sizes and what each skipped allow the threshold, if the two share none of the tokens that they skipped."""
    longest = F.least(na - sa, nb - sb)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (longest * (100 + percent) >= (na + nb) * percent)


ENTRY = "path long, cid long, n long, skipped long, at int"


def _longer(percent: int):
    """Entries with their sets' tokens to entries one token longer, wherever the threshold can still be reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out: list[list[np.ndarray]] = []
            for path, cid, n, skipped, at, tokens, weights in zip(*(part.column(i).to_pylist() for i in range(7))):
                later, w = np.frombuffer(tokens, dtype=U64)[at + 1 :], np.frombuffer(weights, dtype=np.uint32)[at + 1 :].astype(np.int64)
                past = skipped + np.cumsum(w) - w
                k = int(np.searchsorted(past, n - _least(n, percent), "right"))
                if k:
                    longer = mix(later[:k] ^ mix(np.full(k, path, dtype=np.int64).view(U64)))
                    out.append([np.full(k, path, np.int64), longer.view(np.int64), np.full(k, cid, np.int64), np.full(k, n, np.int64), past[:k], np.arange(at + 1, at + 1 + k, dtype=np.int32)])
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["parent", "path", "cid", "n", "skipped", "at"])

    return run


def _grouped(entries: DataFrame, sets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with the label and the bits of their set, and of each group of two labels or more: size, outside (its prevailing label), main."""
    named = sets.select("cid", "bits").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left")
    seen = materialised(entries.join(named, "cid").select(*entries.columns, "bits", F.coalesce("label", "cid").alias("label")))
    counts = seen.groupBy("path", "label").agg(F.count("*").alias("members"))
    groups = counts.groupBy("path").agg(F.sum("members").alias("size"), F.count("*").alias("labels"), F.max(F.struct("members", "label")).alias("most"))
    groups = groups.where("labels > 1").select("path", "size", (F.col("size") - F.col("most.members")).alias("outside"), F.col("most.label").alias("main"))
    return seen, materialised(groups)


def _met(left: DataFrame, seen: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b, size) of ``left`` with the members of its groups in other components.

    Of two sets that reach the threshold at most ``na + nb - 2 required(na, nb)`` shingles are in one alone, and so many bits differ at most.
    """
    left = left.select("path", "size", F.col("cid").alias("a"), F.col("n").alias("an"), F.col("skipped").alias("ap"), F.col("label").alias("al"), F.col("bits").alias("ab"))
    seen = seen.select("path", "cid", "n", "skipped", "label", "bits")
    differ = sum((F.bit_count(F.col("ab")[k].bitwiseXOR(F.col("bits")[k])) for k in range(BITS // 64)), F.lit(0))
    close = (F.col("an") + F.col("n") - differ) * (100 + percent) >= (F.col("an") + F.col("n")) * (2 * percent)
    met = left.join(seen, "path").where((F.col("al") != F.col("label")) & _fits(F.col("an"), F.col("ap"), F.col("n"), F.col("skipped"), percent) & close)
    return met.select(F.greatest("a", "cid").alias("a"), F.least("a", "cid").alias("b"), "size")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    if links.isEmpty():
        return labels
    return materialised(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links)))


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Labels (node, label) of the classes that link with another."""
    entries = sets.select("cid", "n", F.explode("prefix").alias("p")).select(F.col("p.token").alias("path"), "cid", "n", "p.skipped", "p.at")
    pivot = F.min(F.struct(F.xxhash64("cid").alias("rank"), "cid", "n", "skipped")).alias("pivot")
    groups = materialised(entries.groupBy("path").agg(F.count("*").alias("size"), pivot).where("size > 1"))
    entries = materialised(hot_join(entries, groups, ["path"], "size"))
    first = entries.where((F.col("cid") != F.col("pivot.cid")) & _fits(F.col("n"), F.col("skipped"), F.col("pivot.n"), F.col("pivot.skipped"), percent))
    labels = materialised(components(_verified(first.select(F.col("pivot.cid").alias("a"), F.col("cid").alias("b"), "size"), sets, percent)))
    entries = entries.select("path", "cid", "n", "skipped", "at")
    seen, groups = _grouped(entries, sets, labels)
    seen = materialised(hot_join(seen, groups, ["path"], "size"))
    pivots = seen.where(F.pmod(F.xxhash64("cid", "path"), F.col("size")) < PIVOTS)
    labels = _joined(labels, _verified(_met(pivots, seen, percent), sets, percent))
    entries = seen.select("path", "cid", "n", "skipped", "at")
    while True:
        seen, groups = _grouped(entries, sets, labels)
        seen = materialised(hot_join(seen, groups, ["path"], "size"))
        # what one more level would cost at most: each entry is repeated for each token that it may skip to
        steps = F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) - F.col("skipped") + 1)
        large = seen.where(F.col("outside") > FEW).groupBy("path", "size", "outside").agg(steps.alias("steps")).where(f"{GAIN} * steps < size * outside")
        large = materialised(large.select("path", "size", "outside"))
        deeper = None
        if not large.isEmpty():
            parts = hot_join(seen.select("path", "cid", "n", "skipped", "at"), large, ["path"], "size").join(sets.select("cid", "tokens", "weights"), "cid")
            parts = parts.select("path", "cid", "n", "skipped", "at", "tokens", "weights").mapInArrow(tidy(_longer(percent)), "parent long, " + ENTRY)
            deeper, below = _grouped(materialised(parts), sets, labels)
            pairs = below.join(deeper.select("path", "parent").distinct(), "path").groupBy("parent").agg(F.sum(F.col("size") * F.col("outside")).alias("pairs"))
            large = large.join(pairs.withColumnRenamed("parent", "path"), "path", "left").where("2 * coalesce(pairs, 0) <= size * outside")
            large = materialised(large.select("path", "size"))
            deeper = deeper.join(large.select(F.col("path").alias("parent")), "parent", "left_semi").join(below.select("path"), "path", "left_semi").select("path", "cid", "n", "skipped", "at")
        here = seen.join(large.select("path"), "path", "left_anti")
        met = _met(here.where("label <> main"), here, percent)
        if deeper is not None:  # the members of a divided group that share no further token than its path
            star = hot_join(seen.select("path", "cid", "n"), large, ["path"], "size")
            least = star.groupBy("path").agg(F.min(F.struct("n", "cid")).alias("least"), F.count("*").alias("members"))
            star = hot_join(star, materialised(least), ["path"], "members").where("cid <> least.cid")
            met = met.union(star.select(F.greatest("cid", "least.cid").alias("a"), F.least("cid", "least.cid").alias("b"), "size"))
        labels = _joined(labels, _verified(met, sets, percent))
        if deeper is None:
            break
        entries = materialised(deeper)
        if entries.isEmpty():
            break
    return labels


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id that it reaches over links, its own included),
    class_id (least doc_id with the same set; doc_id where there is no set), component (the same for all rows of one
    component, and for these alone, even where ids are repeated; null where there is no set), and a long column ``carry``.

    Words are lower-cased (A-Z) runs of other than white space; a text of fewer than ``width`` words is one shingle of
    all of them.  Null, empty and blank texts have no shingles, link with nothing and are their own component.  Equal
    sets always link.  A repeated doc_id gives one row for each of its rows.  A row whose doc_id is null gets the
    component of its links, null if it has none but itself.  An empty table gives an empty result; other columns are
    not read.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = 4 * partitions(spark)
    extra = [] if carry is None else [carry]
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.lit(None).cast("long") if carry is None else F.col(carry).cast("long")).alias("carried"))
    rows = materialised(docs.mapInArrow(tidy(_signatures(width)), "doc_id long, n_shingles long, f1 long, f2 long, carried long"))
    sent = docs.select("text").mapInArrow(tidy(_shingles(width, buckets)), M.SCHEMA)
    shared = M.dealt(sent).mapInArrow(tidy(_shared(buckets)), M.SCHEMA)
    sets = materialised(M.dealt(shared).mapInArrow(tidy(_ordered(percent)), SETS).dropDuplicates(["f1", "f2", "n"]))
    labels = sets.select("cid", "f1", "f2", "n").join(_links(sets, percent).select(F.col("node").alias("cid"), "label"), "cid")
    labels = labels.select("f1", "f2", F.col("n").alias("n_shingles"), "label")
    key = ["f1", "f2", "n_shingles"]
    classes = materialised(rows.where("f1 is not null").groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")))
    classes = materialised(classes.join(labels, key, "left"))
    reached = materialised(classes.where("label is not null").groupBy("label").agg(F.min("class_id").alias("component_id"), F.count("*").alias("classes")))
    linked = hot_join(classes.where("label is not null"), reached, ["label"], "classes").select(*key, "copies", "class_id", "label", "component_id")
    named = materialised(linked.union(classes.where("label is null").select(*key, "copies", "class_id", "label", F.col("class_id"))))
    component = F.when(F.col("label").isNull(), F.struct("label", "f1", "f2")).otherwise(F.struct("label", F.lit(None).cast("long").alias("f1"), F.lit(None).cast("long").alias("f2")))
    found = hot_join(rows.where("f1 is not null"), named, key, "copies")
    out = ["doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component")]
    blank = rows.where("f1 is null").withColumns({"component_id": F.col("doc_id"), "class_id": F.col("doc_id"), "label": F.lit(None).cast("long")})
    blank = blank.select(*out[:4], F.lit(None).cast("struct<label:long,f1:long,f2:long>").alias("component"), F.col("carried"))
    return found.select(*out, "carried").union(blank).select("doc_id", "n_shingles", "component_id", "class_id", "component", *[F.col("carried").alias(c) for c in extra])
