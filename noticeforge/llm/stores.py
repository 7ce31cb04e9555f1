"""What a Python worker keeps from task to task: one store at a time, as workers go on to other stages and share their executor's memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_KEPT: dict[tuple, Any] = {}


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The worker's store of this key; another one goes first."""
    if key not in _KEPT:
        free()
        _KEPT[key] = make()
    return _KEPT[key]


def free() -> None:
    """Drop the store of an earlier stage, if there is one, and return what that stage has left unused."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Return unused memory to the system, where the allocators can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
