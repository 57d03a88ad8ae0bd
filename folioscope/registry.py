"""Names of the registered queries, what builds them, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "section_search"

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = query
    if sql is not None:
        _ORACLE[name] = sql


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_ORACLE)


def load() -> None:
    """Import the modules that register queries; on the first call for them, since these modules import this one."""
    from .operators import aggregates, clauses, clustering, discovery, edge_cases, graphs, html_maps, joins, kmeans, outlines, parsing, rules, scoring, search, vectors, windows  # noqa: F401
    from .sources import files, incremental  # noqa: F401

