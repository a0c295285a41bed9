"""What operators keep in a worker process between tasks: Spark reuses workers, so when one operator begins, the memos of the others go."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

_clear: dict[str, Callable[[], None]] = {}
_owner: list[str] = [""]


def claim(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """The memo ``name``, which ``clear`` empties, is in use from now on."""
    if _owner[0] == name:
        return
    _owner[0], _clear[name] = name, clear
    for other, empty in _clear.items():
        if other != name:
            empty()
    release()


def release() -> None:
    """Gives memory that nothing holds back to the system: neither the C library nor Arrow does so by itself, and an executor's workers share a limit with its JVM."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)
