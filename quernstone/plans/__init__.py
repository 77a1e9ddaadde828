"""Registered queries: operators bound to the given tables, and the SQL they are checked with."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("keyword", "search", "extract", "graph", "graph_build", "query_log", "context", "sources", "filters", "memory")


def load_all():
    """(queries, check SQL) of every group."""
    from quernstone.plans.registry import ORACLES, QUERIES

    for group in GROUPS:
        import_module(f"quernstone.plans.{group}")
    return dict(QUERIES), dict(ORACLES)
