"""Memory of Python workers, which live on after a task and otherwise keep what it freed."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the machine: Arrow's pool and, where there is one, the C library's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(function: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over batches that gives freed memory back when a task's batches are through."""

    @wraps(function)
    def run(*batches):
        yield from function(*batches)
        give_back()

    return run
