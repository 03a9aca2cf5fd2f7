"""Packing: cost-balanced sequences of at most ``capacity`` tokens.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention within the piece).  Map tasks tokenize documents
and pack them block by block, a block being up to ``block`` tokens of one task.  Pieces of full length are sequences of
their own; what is left of each document goes, dearest first, to the sequence of least cost that has room for it.  A
block has as few sequences as hold its tokens; what no sequence has room for is cut: the sequence of least cost with any
room is filled, and the rest goes on in the same way.  So less than one sequence of padding is left to a block, and
nothing is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.llm.bpe import text_slices
from forkline.llm.memory import tidy
from forkline.llm.pieces import BYTE_PIECES, library_encoder
from forkline.session import ship

CAPACITY = 2048
BLOCK = 1 << 21
END = np.array([1], dtype="<u4").tobytes()

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Sequences:
    """Open sequences by remaining room: a heap of (cost, number) for each room, and a tree of the least of ranges of rooms."""

    def __init__(self, capacity: int, count: int) -> None:
        self.base = 1 << capacity.bit_length()
        self.heaps: dict[int, list[tuple[float, int]]] = {capacity: [(0.0, k) for k in range(count)]}
        self.least = [(inf, 0)] * (2 * self.base)
        self._up(capacity)

    def _up(self, room: int) -> None:
        heap, at = self.heaps[room], self.base + room
        self.least[at] = heap[0] if heap else (inf, 0)
        while at > 1:
            at //= 2
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])

    def take(self, least: int) -> tuple[float, int, int] | None:
        """Remove the cheapest sequence of at least this room: cost, number, room."""
        at, top = self.base + least, self.base
        best, where = self.least[at], at
        while at > 1:  # subtrees right of the path hold larger rooms
            if at % 2 == 0 and self.least[at + 1] < best:
                best, where = self.least[at + 1], at + 1
            at //= 2
        if best[0] == inf:
            return None
        while where < top:
            where = 2 * where if self.least[2 * where] == best else 2 * where + 1
        heapq.heappop(self.heaps[where - top])
        self._up(where - top)
        return *best, where - top

    def put(self, cost: float, number: int, room: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (cost, number))
        self._up(room)


def assign(sizes: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these sizes; sequences are numbered from 0."""
    cost = lambda n: linear * n + quadratic * n * n
    out, sequence, rest = [], 0, []
    for d, size in enumerate(sizes):
        for start in range(0, size - capacity + 1, capacity):
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
        if size % capacity:
            rest.append((size % capacity, d, size - size % capacity))
    rest.sort(key=lambda r: (-r[0], r[1]))
    bins = -(-sum(r[0] for r in rest) // capacity)
    if not bins:
        return out
    sequences = Sequences(capacity, bins)
    for length, d, start in rest:
        while length:
            spent, b, room = sequences.take(length) or sequences.take(1)
            take = min(length, room)
            out.append((d, start, take, sequence + b, capacity - room))
            if take < room:
                sequences.put(spent + cost(take), b, room - take)
            length, start = length - take, start + take
    return out


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian 32-bit).

    A document's tokens are those of the byte-level tokenizer file, then id 1; null and empty texts have that id alone.
    Each token lies in one piece.  doc_id may be null or repeated: every row is packed for itself.  Sequence ids hold
    the number of the task in their upper bits and are not contiguous.  An empty table gives an empty result; other
    columns are not read.
    """
    ship(docs.sparkSession)

    def flush(ids: list, encoded: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        sizes = [len(e) // 4 for e in encoded]
        rows = sorted(assign(sizes, capacity, linear, quadratic), key=lambda p: (p[3], p[4]))
        d, start, length, sequence, offset = (list(c) for c in zip(*rows))
        columns = [
            pa.array([ids[k] for k in d], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([sizes[k] for k in d], pa.int64()),
            pa.array(np.array(sequence, dtype=np.int64) + first), pa.array(offset, pa.int64()),
            pa.array([encoded[k][4 * s : 4 * (s + n)] for k, s, n in zip(d, start, length)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]), first + sequence[-1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path, BYTE_PIECES)
        first = TaskContext.get().partitionId() << 40
        ids, encoded, total = [], [], 0
        for part in batches:
            at = 0
            for texts in text_slices(part.column(1)):
                new = [e + END for e in encoder.ids(texts)]
                ids += part.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                encoded += new
                total += sum(map(len, new)) // 4
                if total >= block:
                    out, first = flush(ids, encoded, first)
                    yield out
                    ids, encoded, total = [], [], 0
        if ids:
            yield flush(ids, encoded, first)[0]

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run, caches=True), SCHEMA)
