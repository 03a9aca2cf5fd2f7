"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

1.  Map tasks hash every window of ``width`` words.  Of a hash they send the least doc_id among the documents they hold
    (pre-aggregation: a passage that a third of all documents share comes once from each task, not once from each
    document) and answer the others themselves.
2.  Reduce tasks find the least doc_id of each hash overall and answer the documents of the rest.
3.  Documents meet their answers by a hash of doc_id; repeated windows merge into maximal intervals of words, which go.

Windows are judged on the input.  A window counts as repeated if its words also start in a document with a smaller
doc_id; a repetition within one document, or between rows with one doc_id, is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.llm import messages as M
from forkline.llm.hashing import Words, slices, window_hashes, word_hashes
from forkline.llm.memory import tidy
from forkline.session import partitions, ship

U64 = np.uint64


def spark_xxhash64(values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one long (XXH64 of eight bytes, seed 42)."""
    # The primes of XXH64.
    p1, p2, p3, p4, p5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    rotl = lambda x, n: (x << U64(n)) | (x >> U64(64 - n))
    h = (np.full(len(values), 50, dtype=U64) + p5) ^ (rotl(values.astype(np.int64).view(U64) * p2, 31) * p1)
    h = rotl(h, 27) * p1 + p4
    h = (h ^ (h >> U64(33))) * p2
    h = (h ^ (h >> U64(29))) * p3
    return h ^ (h >> U64(32))


def _home(doc_ids: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(spark_xxhash64(doc_ids).view(np.int64), buckets)


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document (index in the slice) of every window."""
    counts = np.maximum(np.diff(words.first) - width + 1, 0)
    document = np.repeat(np.arange(words.documents), counts)
    start = np.arange(len(document)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = window_hashes(word_hashes(words, fold=False), width)
    return hashes[words.first[document] + start], document


def _answers(owner: np.ndarray, hashes: np.ndarray, buckets: int, sign: int = 0) -> tuple[list[int], list[bytes]]:
    """Messages of repeated windows to the homes of their documents; with ``sign`` -1 under negative buckets, for tasks to pass on."""
    home = _home(owner, buckets)
    order = np.lexsort((owner, home))
    owner, home, hashes = owner[order], home[order], hashes[order]
    bounds = [(int(lo), int(hi)) for lo, hi in zip(*M.runs(home))]
    at = [-1 - int(home[lo]) if sign else int(home[lo]) for lo, _ in bounds]
    return at, [M.pack(*M.owners(owner[lo:hi]), hashes[lo:hi]) for lo, hi in bounds]


def _send(parts: list[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    hashes, owner = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(hashes)
    ordered = hashes[order]
    again = np.zeros(len(hashes) + 1, dtype=bool)
    again[1:-1] = ordered[1:] == ordered[:-1]
    order = order[again[:-1] | again[1:]]  # windows met more than once
    sends = np.ones(len(hashes), dtype=bool)
    if len(order):
        order = order[np.lexsort((owner[order], hashes[order]))]
        starts, ends = M.runs(hashes[order])
        sends[order] = False
        sends[order[starts]] = True
        late = order[owner[order] > np.repeat(owner[order][starts], ends - starts)]
        if len(late):
            yield M.batch(*_answers(owner[late], hashes[late], buckets, -1))
    hashes, owner = hashes[sends], owner[sends]
    if (owner[1:] < owner[:-1]).any():
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    order, bounds = M.by_bucket(hashes, buckets)
    hashes, owner = hashes[order], owner[order]
    at, out = [], []
    for b in range(buckets):
        lo, hi = bounds[b], bounds[b + 1]
        if hi > lo:
            at.append(b)
            out.append(M.pack(*M.owners(owner[lo:hi]), hashes[lo:hi]))
    yield M.batch(at, out)


def _windows(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        total, most = 0, M.flush(buckets)
        for part in batches:
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for words in slices(part.column(1)):
                hashes, document = windows(words, width)
                parts.append((hashes, ids[words.begin + document]))
                total += len(hashes)
                if total > most:
                    yield from _send(parts, buckets)
                    parts, total = [], 0
        if total:
            yield from _send(parts, buckets)

    return run


def _repeated(buckets: int):
    """Messages of windows to answers for the documents that are not the first with one; answers that map tasks gave go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        passed: list[tuple[int, bytes]] = []

        def group(bucket: int, payloads: list[bytes]) -> None:
            if bucket < 0:
                passed.extend((-1 - bucket, p) for p in payloads)
                return
            parts = [M.unpack(p) for p in payloads]
            owner = np.concatenate([np.repeat(*M.owned(*p[:3])) for p in parts])
            hashes = np.concatenate([p[3] for p in parts])
            del parts
            order = np.argsort(hashes)
            ordered = hashes[order]
            again = np.zeros(len(hashes) + 1, dtype=bool)
            again[1:-1] = ordered[1:] == ordered[:-1]
            order = order[again[:-1] | again[1:]]
            owner, hashes = owner[order], hashes[order]
            if len(hashes):
                starts, ends = M.runs(hashes)
                late = owner > np.repeat(np.minimum.reduceat(owner, starts), ends - starts)
                found.append((owner[late], hashes[late]))

        def send() -> Iterator[pa.RecordBatch]:
            if passed:
                yield M.batch(*map(list, zip(*passed)))
                passed.clear()
            if found:
                owner, hashes = (np.concatenate(x) for x in zip(*found))
                found.clear()
                yield M.batch(*_answers(owner, hashes, buckets))

        most = M.flush(buckets)
        for _ in M.grouped(batches, group):
            if sum(len(x[0]) for x in found) > most or len(passed) > 1000:
                yield from send()
        yield from send()

    return run


def _told(payloads: list[bytes]) -> dict[int, list[np.ndarray]]:
    """Hashes of repeated windows by doc_id."""
    told: dict[int, list[np.ndarray]] = {}
    for payload in payloads:
        first, steps, sizes, hashes = M.unpack(payload)
        who, counts = M.owned(first, steps, sizes)
        ends = np.cumsum(counts)
        for d, lo, hi in zip(who.tolist(), (ends - counts).tolist(), ends.tolist()):
            told.setdefault(d, []).append(hashes[lo:hi])
    return told


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _removed(width: int):
    """Rows (bucket, kind, payload, doc_id, text, kept): answers (kind 0) precede the documents of their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, told = None, [], None
        for part in batches:
            buckets, kinds = part.column(0).to_numpy(), part.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (buckets[1:] != buckets[:-1]) | (kinds[1:] != kinds[:-1])))).tolist() + [len(buckets)]
            for lo, hi in zip(edges, edges[1:]):
                if buckets[lo] != bucket:
                    bucket, held, told = buckets[lo], [], None
                if kinds[lo] == 0:
                    held.extend(part.column(2).slice(lo, hi - lo).to_pylist())
                    continue
                if told is None:
                    told, held = _told(held), []
                yield _apply(part.slice(lo, hi - lo), told, width)

    return run


def _apply(part: pa.RecordBatch, told: dict, width: int) -> pa.RecordBatch:
    ids = part.column(3).to_pylist()
    n_words, n_removed, kept, spans = [], [], [], []
    for words in slices(part.column(4)):
        first = words.first.tolist()
        mine = [ids[words.begin + d] for d in range(words.documents)]
        hashes = window_hashes(word_hashes(words, fold=False), width) if any(d in told for d in mine) else None
        for d, doc_id in enumerate(mine):
            a, b = first[d], first[d + 1]
            all_words = words.data[words.offsets[d] : words.offsets[d + 1]].tobytes().split()
            gone = np.zeros(b - a, dtype=bool)
            if doc_id in told and b - a >= width:
                at = np.flatnonzero(np.isin(hashes[a : b - width + 1], np.concatenate(told[doc_id])))
                depth = np.zeros(b - a + 1, dtype=np.int32)
                depth[at] += 1
                depth[at + width] -= 1
                gone = np.cumsum(depth[:-1]) > 0
            if not gone.any():
                n_removed.append(0)
                spans.append([])
                kept.append(b" ".join(all_words))
            else:
                n_removed.append(int(gone.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
                kept.append(b" ".join(compress(all_words, ~gone)))
            n_words.append(b - a)
    return pa.RecordBatch.from_arrays(
        [part.column(3), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary()).cast(pa.string()), part.column(5)],
        names=["doc_id", "n_words", "n_removed", "spans", "kept_text", "carried"],
    )


def substring_dedup(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, spans (removed words, start to end), kept_text, carried.

    ``kept_text`` is the words that stay, joined by one space; ``carried`` a struct of the columns ``carry`` as c0, c1 and so on.  Words are
    compared as they are.  A null text has no words; texts shorter than ``width`` words lose nothing; of equal texts
    that of the least doc_id stays whole, and rows with one doc_id do not count against each other, but are judged
    alike.  A row with null doc_id is returned whole and takes no part.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = 4 * partitions(spark)
    carried = F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]).alias("carried")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), carried)
    sent = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(tidy(_windows(width, buckets)), M.SCHEMA)
    answers = M.dealt(sent).mapInArrow(tidy(_repeated(buckets)), M.SCHEMA)
    none = lambda name: F.lit(None).cast(docs.schema[name].dataType).alias(name)
    rows = answers.select("bucket", F.lit(0).alias("kind"), "payload", none("doc_id"), none("text"), none("carried"))
    home = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(buckets)).cast("int")
    rows = rows.union(docs.select(home.alias("bucket"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("payload"), "doc_id", "text", "carried"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "kind")
    schema = f"doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string, carried {docs.schema['carried'].dataType.simpleString()}"
    return rows.mapInArrow(tidy(_removed(width)), schema)
