"""What a Python worker remembers from task to task: the caches of one operator at a time.

Workers outlive a stage. When another operator's task starts in a worker, the caches of the one before are
dropped and freed memory goes back to the system, so a pipeline's workers don't add up all its operators.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_held: dict[str, dict] = {}


def trim() -> None:
    """Give freed memory back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def cache_of(owner: str) -> dict:
    """The operator's cache in this worker."""
    if owner not in _held:
        _held.clear()
        gc.collect()
        trim()
        _held[owner] = {}
    return _held[owner]
