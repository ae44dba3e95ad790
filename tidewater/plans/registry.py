"""All queries over the driver tables and their DuckDB SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query under its name in the operator inventory."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _load() -> None:
    """The modules register their queries as they are imported."""
    import importlib

    for name in ("q_agents", "q_composites", "q_feeds", "q_joins", "q_more", "q_tables", "q_text", "q_upkeep"):
        importlib.import_module(f"tidewater.plans.{name}")


_load()
