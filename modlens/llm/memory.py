"""One operator's kept words at a time: Python workers serve one operator after the other."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_kept: dict[str, Callable[[], None]] = {}


def only(name: str, clear: Callable[[], None]) -> None:
    """Tasks of the operator `name` run now: what others have kept in this process goes."""
    others = [n for n in _kept if n != name]
    for other in others:
        _kept.pop(other)()
    _kept[name] = clear
    if others:
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system, where its allocators can do so; else they would keep it for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass
