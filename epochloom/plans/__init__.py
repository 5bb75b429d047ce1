"""Registered queries and their SQL, one module a family."""

from __future__ import annotations

import importlib

#: Modules of this package with ``QUERIES`` and ``ORACLE_SQL``.
MODULES = ("timestamps", "spikes", "grid", "epochs")


def collect() -> tuple[dict, dict]:
    """All queries and all SQL of the modules above."""
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        sql |= module.ORACLE_SQL
    return queries, sql
