"""The table of queries: a name, a plan over (session, directory) and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(plan: Callable) -> Callable:
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return keep
