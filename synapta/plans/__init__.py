"""Every registered query: a Spark function and, where SQL can express it, the DuckDB statement."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

_queries: dict[str, Callable] = {}
_oracles: dict[str, str] = {}
_loaded = False


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def register(f):
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return register


def _load() -> None:
    global _loaded
    if not _loaded:
        for module in pkgutil.iter_modules(__path__):
            importlib.import_module(f"{__name__}.{module.name}")
        _loaded = True


def queries() -> dict[str, Callable]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
