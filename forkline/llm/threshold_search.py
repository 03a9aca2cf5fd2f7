"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are packed into blocks of rows, queries into blocks of queries; every block of rows meets every block of queries
once.  In a meeting each dimension is a list of rows in order of its component.  A query goes down its lists (from the
large end where its component is positive, from the small end where negative, not at all where it is zero), scores every
row that it has not met before, and stops when the bound cannot reach the k-th best score: no row unseen so far exceeds
the components reached in the lists, nor the greatest length of the block's rows.  (A tie might still be a row of smaller
id, so it goes on.)  The k-th best is that of the block or that of a first pass over ``FIRST`` rows, which every block
knows, whichever is higher.  Of the lists those go on that make up half of the bound, by steps that double; a query that
does not stop has met all rows of the block at the end of a list.
The k best of each block are ranked in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forkline.llm.memory import tidy
from forkline.session import materialised, ship

ROWS, QUERIES = 4096, 2048
#: Rows of the first pass, blocks of rows that one task meets with a block of queries, and the first step down a list.
FIRST, MEETINGS, STEP = 4 * ROWS, 256, 16
#: Up to here integers are exact in double precision.
EXACT = 1 << 53
BLOCKS = pa.schema([("dimensions", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("floors", pa.binary())])
BLOCK = "dimensions int, part int, ids binary, vectors binary, floors binary"
#: Floor of a query of which nothing is known.
NONE = -(1 << 63)


def _blocks(size: int, numbered: bool):
    """Rows (id, vector, floor) to blocks of at most ``size`` vectors of equal dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        part = TaskContext.get().partitionId() if numbered else 0

        def block(d: int) -> pa.RecordBatch:
            ids, vectors, floors = held.pop(d)
            parts = [np.array(ids, dtype=np.int64).tobytes(), np.concatenate(vectors).tobytes() if d else b"", np.array(floors, dtype=np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], schema=BLOCKS)

        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            start = 0
            for vec_id, end, floor in zip(batch.column(0).to_pylist(), ends.tolist(), batch.column(2).to_pylist()):
                d = end - start
                ids, vectors, floors = held.setdefault(d, ([], [], []))
                ids.append(vec_id)
                floors.append(floor)
                vectors.append(values[start:end])
                start = end
                if len(ids) == size:
                    yield block(d)
        for d in list(held):
            yield block(d)

    return run


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond 64 bits they stop at the least or greatest long."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(1, rows.shape[1])
    if most < 1 << 53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return rows @ query
    return np.clip(rows.astype(object) @ query.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best, ties to smaller ids, the query's own id left out."""
    at = np.flatnonzero(ids != own)
    if len(at) > 4 * k:
        at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
    return at[np.lexsort((ids[at], ~scores[at]))][:k]


def bound(query: np.ndarray, reached: np.ndarray, length: float) -> int:
    """The greatest inner product of ``query`` with integer vectors of at most ``length`` that lie, seen from the query's
    signs, at or below ``reached`` in every dimension."""
    weight, cap = np.abs(query).astype(np.float64), np.where(query < 0, -reached, reached).astype(np.float64)
    total = float(weight @ np.minimum(cap, 0))  # components that must point away
    weight, cap = weight[cap > 0], cap[cap > 0]
    weight, cap = weight[weight > 0], cap[weight > 0]
    if float(cap @ cap) > length * length:
        # the best such vector is min(cap, m * weight) for the m that gives it the full length
        order = np.argsort(cap / weight)
        weight, cap = weight[order], cap[order]
        spent, free = np.cumsum(cap * cap), np.cumsum((weight * weight)[::-1])[::-1]
        over = spent + np.append(free[1:], 0.0) * (cap / weight) ** 2 > length * length
        if over.any():
            k = int(np.argmax(over))
            m = np.sqrt(max(0.0, length * length - (spent[k - 1] if k else 0.0)) / free[k])
            cap = np.minimum(cap, m * weight)
    total += float(weight @ cap)
    return int(np.ceil(total + 1e-9 * abs(total) + 1))


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query: its id, ids and scores of its k best rows of the block (those that its floor, a lower bound of its
    k-th best score over all blocks, does not rule out, at least), and the number of rows that it met."""
    n, d = rows.shape
    order = np.argsort(rows, axis=0, kind="stable")
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, d)
    dense = rows.astype(np.float64) if most < EXACT else rows
    length = float(np.sqrt((dense.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))
    for query, own, floor in zip(queries, query_ids.tolist(), floors.tolist()):
        up, weight = query > 0, np.abs(query).astype(np.float64)
        depth, lists = np.zeros(d, dtype=np.int64), np.flatnonzero(query)
        fresh = np.ones(n, dtype=bool)
        best_ids, best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            if len(lists):
                before, depth[lists] = depth[lists], np.minimum(np.maximum(STEP, 2 * depth[lists]), n)
                here = [order[n - to : n - at, i] if up[i] else order[at:to, i] for i, at, to in zip(lists.tolist(), before.tolist(), depth[lists].tolist())]
                marked = np.zeros(n, dtype=bool)
                marked[np.concatenate(here)] = True
                new = np.flatnonzero(marked & fresh)
            else:  # all scores are 0
                new = np.arange(n)
            fresh[new] = False
            scores = (dense[new] @ query.astype(np.float64)).astype(np.int64) if most < EXACT else products(rows[new], query)
            best_ids, best_scores = np.concatenate((best_ids, ids[new])), np.concatenate((best_scores, scores))
            best = _best(best_ids, best_scores, own, k)
            best_ids, best_scores = best_ids[best], best_scores[best]
            if not fresh.any():
                break
            walked = np.flatnonzero(query)
            place = np.where(up[walked], n - np.maximum(depth[walked], 1), np.maximum(depth[walked], 1) - 1)
            reached = np.zeros(d, dtype=np.int64)
            reached[walked] = rows[order[place, walked], walked]
            kth = max(floor, int(best_scores[-1])) if len(best_ids) == k else floor
            if most < EXACT and kth > bound(query, reached, length):
                break
            # the lists that make up half of what the bound consists of go on
            share = weight[walked] * np.maximum(np.where(up[walked], reached[walked], -reached[walked]), 0)
            first = np.argsort(-share, kind="stable")
            lists = walked[first[: 1 + int(np.searchsorted(np.cumsum(share[first]), share.sum() / 2))]]
        yield own, best_ids, best_scores, n - int(fresh.sum())


FOUND = "query_id long, vec_id long, score long, met long"


def _met(k: int):
    """Meetings (ids, vectors, query_ids, queries, floors) to the best rows of each query, with the rows met for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for d, ids, rows, query_ids, queries, floors in zip(*(part.column(i).to_pylist() for i in range(6))):
                ids, query_ids, floors = (np.frombuffer(x, np.int64) for x in (ids, query_ids, floors))
                rows, queries = np.frombuffer(rows, np.int64).reshape(len(ids), d), np.frombuffer(queries, np.int64).reshape(len(query_ids), d)
                found = list(search(ids, rows, query_ids, queries, floors, k))
                counts = [len(f[1]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[0] for f in found], counts).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found])), pa.array(np.repeat([f[3] for f in found], counts).astype(np.int64))],
                    names=["query_id", "vec_id", "score", "met"],
                )

    return run


def _meetings(rows: DataFrame, queries: DataFrame, parts: int, salts: int, k: int) -> DataFrame:
    """Best rows by query and block; each block of queries is repeated ``salts`` times, so that ``parts * salts`` tasks can share the rows."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))
    rows = rows.select("dimensions", "salt", "ids", "vectors", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asking = queries.select("dimensions", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), "floors")
    met = rows.join(asking, ["dimensions", "part", "salt"]).select("dimensions", "ids", "vectors", "query_ids", "queries", "floors")
    return met.mapInArrow(tidy(_met(k)), FOUND)


def threshold_search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` best rows of each query: query_id, rank (from 1), vec_id, score; all, if there are fewer.  met: the rows
    that the query met in the block where it found this one.

    Queries are the rows whose id ``every`` divides, candidates all rows but those of the query's own id; components x count as
    floor(scale * x).  Ties go to the smaller vec_id.  Rows with a null id or vector, or with a null or non-finite
    component, take no part; vectors of other dimensions than the query's are no candidates.  Of repeated query ids the
    least vector asks; repeated candidates each have a rank.  Tables without queries give an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    clean = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite).select(F.col(vec_id).cast("long").alias("id"), whole.alias("vector"))
    asked = materialised(clean.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("vector").alias("vector")))
    parts = -(-asked.count() // QUERIES)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, met long")

    def blocks(of: DataFrame, size: int, numbered: bool) -> DataFrame:
        return of.mapInArrow(tidy(_blocks(size, numbered)), BLOCK)

    unknown = F.lit(NONE).alias("floor")
    first = blocks(clean.limit(FIRST).select("id", "vector", unknown), ROWS, False)
    queries = materialised(blocks(asked.select("id", "vector", unknown).repartition(parts), QUERIES, True))
    known = _meetings(first, queries, parts, 1, k).select("query_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))).alias("place"))
    known = known.where(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    asked = asked.join(known, "id", "left").select("id", "vector", F.coalesce("floor", unknown).alias("floor"))
    queries = materialised(blocks(asked.repartition(parts), QUERIES, True))
    rows = materialised(blocks(clean.select("id", "vector", unknown), ROWS, False))
    found = _meetings(rows, queries, parts, -(-rows.count() // MEETINGS) or 1, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "met")
