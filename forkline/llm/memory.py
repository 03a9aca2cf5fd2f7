"""Memory of Python workers between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Tasks = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


_kept: list[dict] = []


def kept(cache: dict) -> None:
    """Name a cache that a worker holds from task to task, until a task that does not use it begins."""
    _kept.append(cache)


def tidy(run: Tasks, caches: bool = False) -> Tasks:
    """``run`` for mapInArrow, after which a worker gives back what it has freed; ``caches``: it uses what workers keep.

    Workers live on from stage to stage; what one stage took would otherwise stand beside what the next needs.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not caches:
            for cache in _kept:
                cache.clear()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return whole
