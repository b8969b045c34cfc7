"""The registered queries of the engine's own operators, grouped as the operators are."""

from __future__ import annotations

from importlib import import_module

from ..registry import ORACLE, QUERIES

GROUPS: tuple[str, ...] = ("joins", "aggregates", "windows", "selection", "text", "arrays", "projections", "mining", "sources", "streams")


def queries() -> dict:
    """Every registered query."""
    for group in GROUPS:
        import_module(f"{__name__}.{group}")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of the registered queries that have one."""
    queries()
    return dict(ORACLE)
