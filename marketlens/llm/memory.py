"""Memory of Python workers between batches."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Hand freed memory back to the system.  Workers stay for later stages
    and would otherwise keep the most that any batch of theirs took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call on this system
        pass
