"""What a Python worker keeps between tasks.

Workers are reused, so what one operator remembers for its next task would stay beside what another operator needs."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_held: tuple[str, Callable[[], None]] | None = None


def claim(owner: str, forget: Callable[[], None] | None = None) -> None:
    """To be called as a task begins: drops what another owner has left, and gives freed memory back.

    ``forget`` is how ``owner``'s own memory is dropped when another takes over."""
    global _held
    if _held and _held[0] != owner:
        _held[1]()
        gc.collect()
    _held = (owner, forget) if forget else None
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
