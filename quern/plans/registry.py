"""All queries of the core library and their SQL."""

from __future__ import annotations

from quern.plans import catalog_queries, evolve_queries, graph_queries, index_queries, ingest_queries, point_queries, search_queries, trace_queries

_ALL = [search_queries.R, catalog_queries.R, trace_queries.R, graph_queries.R, evolve_queries.R, ingest_queries.R, index_queries.R, point_queries.R]


def queries() -> dict:
    return {k: v for r in _ALL for k, v in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for r in _ALL for k, v in r.sql.items()}
