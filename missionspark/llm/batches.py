"""Arrow batches in parts of few rows, and tasks that give back what they no longer hold."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa


def slices(batches, rows: int = 512):
    """Batches of at most so many rows, so that few texts are held with what is made of them."""
    return (b.slice(at, rows) for b in batches for at in range(0, max(1, b.num_rows), rows))


def give_back() -> None:
    """Returns freed memory to the system; Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's own
    if trim is not None:
        trim(0)


def lean(task):
    """A task over batches that calls :func:`give_back` now and then and at its end, as Spark keeps its Python process for later tasks."""

    @functools.wraps(task)
    def run(batches):
        try:
            for k, batch in enumerate(task(batches)):
                yield batch
                if k % 8 == 7:
                    give_back()
        finally:
            give_back()

    return run
