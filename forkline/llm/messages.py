"""Rows that carry numpy arrays between map and reduce tasks.

A shuffle of one row for each hash would spend most of its time on row headers.  Map tasks instead sort what they
have by bucket and send one row (bucket, payload) for each; Spark deals the rows by bucket, sorts and spills them, and
reduce tasks read one bucket after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "bucket int, payload binary"
ARROW = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
#: Values that a map task gathers before it sends; bounds its memory.
FLUSH = 1 << 19


def flush(buckets: int) -> int:
    """``FLUSH``, or more where a message would hold very few values."""
    return max(FLUSH, 32 * buckets)


_KINDS = [np.dtype(k) for k in (np.uint8, np.uint16, np.uint32, np.uint64, np.int64, np.int32, np.float64)]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each with its type and size."""
    head = np.array([a.nbytes * 16 + _KINDS.index(a.dtype) for a in arrays], dtype=np.int64)
    return bytes([len(arrays)]) + head.tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack(payload: bytes) -> list[np.ndarray]:
    head = np.frombuffer(payload, dtype=np.int64, count=payload[0], offset=1).tolist()
    at, out = 1 + 8 * len(head), []
    for entry in head:
        kind, size = _KINDS[entry % 16], entry // 16
        out.append(np.frombuffer(payload, dtype=kind, count=size // kind.itemsize, offset=at))
        at += size
    return out


def shrunk(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest type that holds them all."""
    most = int(values.max(initial=0))
    return values.astype(next(k for k in _KINDS[:4] if most <= np.iinfo(k).max))


def owners(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending owners (int64) of values as three small arrays: the first, steps to the next ones, values of each."""
    starts, ends = runs(owner)
    who = owner[starts]
    return who[:1], shrunk(np.diff(who).view(np.uint64)), shrunk(ends - starts)


def owned(first: np.ndarray, steps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct owners and how many values each has."""
    return np.cumsum(np.concatenate((first, steps.astype(np.int64)))), counts.astype(np.int64)


def batch(buckets: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], schema=ARROW)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.append(starts[1:], len(values))


def by_bucket(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the values by bucket (value modulo ``buckets``), and the bounds of each bucket in it."""
    at = (values % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(buckets + 1))


def dealt(messages: DataFrame) -> DataFrame:
    """Messages of a bucket together, one bucket after another in a task."""
    return messages.repartition("bucket").sortWithinPartitions("bucket")


def grouped(batches: Iterator[pa.RecordBatch], group: Callable[[int, list[bytes]], None]) -> Iterator[int]:
    """Call ``group(bucket, payloads)`` for each bucket of sorted messages, then yield the bucket."""
    bucket, held = None, []
    for part in batches:
        for b, payload in zip(part.column(0).to_pylist(), part.column(1)):
            if b != bucket and held:
                group(bucket, held)
                held = []
                yield bucket
            bucket = b
            held.append(payload.as_buffer().to_pybytes())
    if held:
        group(bucket, held)
        yield bucket
