"""Queries and their SQL, by name. Modules of lodegraph.plans register theirs with @query."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}
#: Modules whose import registers queries.
MODULES: tuple[str, ...] = tuple(f"lodegraph.plans.{m}" for m in ("graph_queries", "retrieval_queries", "history_queries", "relational_queries", "more_queries"))


def query(name: str, oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame as name, with the SQL that gives the same rows."""

    def put(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return put


def _load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
