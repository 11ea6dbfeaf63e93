"""What a reused Python worker keeps between tasks, and what it gives back.

Spark reuses Python workers for all stages of an application, so whatever a
task leaves behind stays for the next stage.  A worker therefore holds the
state of one operator at a time (vocabulary, model, word memo; each bounded
in bytes by its owner), and returns freed memory to the system when a task
ends.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """The value of ``key``, made if this worker does not hold it; what it held for another key goes first."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, an Arrow function, with freed memory returned to the system at its end."""
    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()
    return tidied


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
