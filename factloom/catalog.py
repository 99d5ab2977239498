"""Registered queries of the memory engine and the DuckDB SQL that each agrees with."""

from __future__ import annotations

from factloom.plans import citation_queries, erasure_queries, graph_queries, ops_queries, recall_queries, replay_queries, report_queries, semantic_queries, store_queries, write_queries

_PARTS = [recall_queries, write_queries, ops_queries, graph_queries, store_queries, citation_queries, erasure_queries, replay_queries, semantic_queries, report_queries]


def united(parts: list[dict]) -> dict:
    """All entries of the parts; a name that two of them use is refused, as one would take the other's place unseen."""
    names = [name for part in parts for name in part]
    if twice := {name for name in names if names.count(name) > 1}:
        raise ValueError(f"registered more than once: {sorted(twice)}")
    return {name: value for part in parts for name, value in part.items()}


QUERIES = united([part.QUERIES for part in _PARTS])
ORACLES = united([part.ORACLES for part in _PARTS])
