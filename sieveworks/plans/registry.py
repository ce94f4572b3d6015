"""The registry of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from sieveworks.sources import tables as T

FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None, views: bool = True):
    """Registers a function by its name, with SQL over the views."""

    def add(f):
        FOUND[f.__name__] = (f, T.with_views(sql) if sql and views else sql)
        return f

    return add
