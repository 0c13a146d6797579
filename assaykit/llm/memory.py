"""Giving memory back: Python workers stay for later tasks, and several wait beside those at work."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Returns what this process has freed but still holds, to the operating system where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a worker's generator function, with release() once it is through."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
