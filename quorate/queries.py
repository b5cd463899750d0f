"""All queries of the core, and their SQL."""

from __future__ import annotations

from .registry import building, functions, inputs, metrics, nested, serving

AREAS = (nested, metrics, building, serving, functions, inputs)


def queries() -> dict:
    return {k: f for a in AREAS for k, f in a.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for a in AREAS for k, s in a.SQL.items()}
