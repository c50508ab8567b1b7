"""Arrow batches in small slices, so that what a task makes of one is small as well."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Memory that is free in this process goes back to the system; a worker that serves many stages else keeps the most that any took."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # of glibc
        trim(0)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``task`` makes; once it has ended, all that it took goes back to the system, as its worker may stand idle beside others for long."""
    yield from task(batches)
    give_back()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Views of at most ``rows`` rows; an empty batch stays one. What an earlier task of the worker left free is given back first."""
    give_back()
    for b in batches:
        for i in range(0, max(b.num_rows, 1), rows):
            yield b.slice(i, rows)
