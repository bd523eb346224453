"""Registry of named queries (one per inventory ID) and their SQL oracles.

``queries()`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``oracle_sql()``
maps the same name to an ANSI SQL text over the driver's tables, present only
where the operator is expressible exactly in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a query under ``name`` with an optional oracle."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from mailsift.plans import (queries_eval, queries_features, queries_labels,  # noqa: F401
                                queries_logs, queries_models, queries_profile, queries_shape,
                                queries_sources, queries_text, queries_udf)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)


def sql_list(values) -> str:
    """A SQL ``IN`` list literal."""
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"
