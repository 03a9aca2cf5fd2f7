"""Vectorised word, shingle and window hashes over Arrow string columns.

Everything works on the UTF-8 bytes of a slice of documents laid end to end, so that a task holds a few
megabytes of working arrays whatever the size of the incoming batch.  Words are maximal runs of bytes other
than 0x20 and 0x09-0x0D, which is the same as ``[^\\x20\\x09-\\x0D]+`` over characters, because every byte of
a multi-byte character is 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
U64 = np.uint64
_BYTE_BASE = U64(0x9E3779B97F4A7C1B)
_WORD_BASE = U64(0xC2B2AE3D27D4EB53)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), a bijection on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _table(fold: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    if fold:
        t[65:91] = t[97:123]
    return t


_TABLES = {False: _table(False), True: _table(True)}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, U64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


@dataclass
class Words:
    """The words of consecutive documents: ``data[starts[i]:ends[i]]``; document d has words first[d]:first[d + 1]."""

    begin: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def documents(self) -> int:
        return len(self.first) - 1


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Words]:
    """Cut a column into runs of documents of about ``size`` bytes (one document at least) and find their words."""
    data, offsets = string_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield _words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end


def _words(data: np.ndarray, offsets: np.ndarray, begin: int) -> Words:
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    after = np.empty_like(solid)
    if len(data):
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return Words(begin, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(words: Words, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word; ``fold`` takes A-Z as a-z."""
    up, down = _BYTE_POWERS.upto(len(words.data) + 1)
    sums = np.zeros(len(words.data) + 1, dtype=U64)
    np.cumsum(_TABLES[fold][words.data] * up[: len(words.data)], dtype=U64, out=sums[1:])
    return mix((sums[words.ends] - sums[words.starts]) * down[words.starts] + (words.ends - words.starts).astype(U64))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rolling (Rabin-Karp) polynomial of each run of ``width`` hashes; runs across documents are the caller's to skip."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=U64)
    up, down = _WORD_POWERS.upto(n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(hashes * up[:n], dtype=U64, out=sums[1:])
    return (sums[width:] - sums[:-width]) * down[: n - width + 1]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """``rolled``, mixed so that all bits depend on all words."""
    return mix(rolled(hashes, width))


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of one whole sequence of word hashes, shorter than a window."""
    return window_hashes(hashes, len(hashes))[0] ^ U64(len(hashes))


def shingle_sets(words: Words, width: int, fold: bool = True) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its ``width``-word shingles (all words as one, if fewer)."""
    hashes = word_hashes(words, fold)
    windows = window_hashes(hashes, width)
    first = words.first.tolist()
    for a, b in zip(first, first[1:]):
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        elif b > a:
            yield np.array([sequence_hash(hashes[a:b])], dtype=U64)
        else:
            yield np.zeros(0, dtype=U64)


def set_fingerprint(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that identify a set of hashes, as signed integers."""
    out = np.array([mix(values + U64(1)).sum(dtype=U64), mix(values ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)], dtype=U64).view(np.int64)
    return int(out[0]), int(out[1])
