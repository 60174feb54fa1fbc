"""What a Python worker keeps in memory between two tasks, or two groups of one task.

A worker lives on for the tasks that follow. What Arrow's pool and the C library's allocator have once taken they keep, free or not,
so an executor would hold the peak of every worker beside its heap for as long as the session lasts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not in every C library
    _trim = None


def give_back() -> None:
    """Returns freed memory to the machine."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for ``mapInArrow`` that gives memory back when its task ends."""

    @wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def lean_group(group: Callable[[pa.Table], pa.Table]):
    """The same for ``applyInArrow``, after every group."""

    @wraps(group)
    def run(table):
        try:
            return group(table)
        finally:
            give_back()

    return run


def lean_cogroup(groups: Callable[[pa.Table, pa.Table], pa.Table]):
    """The same for groups of two tables."""

    @wraps(groups)
    def run(left, right):
        try:
            return groups(left, right)
        finally:
            give_back()

    return run
