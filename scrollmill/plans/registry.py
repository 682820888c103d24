"""Registered queries and their oracle SQL."""

from __future__ import annotations

from scrollmill.plans import import_queries, merge_queries, read_queries, search_queries, status_queries, testbed  # noqa: F401


def queries() -> dict:
    return dict(testbed.REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(testbed.ORACLES)
