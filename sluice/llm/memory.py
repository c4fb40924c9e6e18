"""What a Python worker gives back when a task is done: workers live on, and an executor counts what all of them hold."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(run: Run) -> Run:
    """``run``, after which free memory goes back to the system."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    # glibc has it, other C libraries need not
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
