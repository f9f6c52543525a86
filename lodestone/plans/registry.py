"""Named queries over the driver's tables, with their SQL."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def oracle_of(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _SQL[name]


def _load() -> None:
    from . import event_queries, index_queries, intake_queries, memory_queries, more_queries, response_queries, rest_queries, search_queries, state_queries, store_queries  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_SQL)
