"""Python workers outlive their tasks: what a task has freed goes back to the system, so that idle ones stay small."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Return freed memory that Arrow and the C library hold for later; elsewhere than in glibc only Arrow's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable) -> Callable:
    """``run``, a generator over a task's batches, that gives memory back when it ends."""

    @functools.wraps(run)
    def inner(*args, **kwargs) -> Iterator:
        try:
            yield from run(*args, **kwargs)
        finally:
            give_back()

    return inner
