"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, shared: str = "") -> Callable[[Callable], Callable]:
    """Register a query under its function's name.  ``shared``: common table
    expressions before ``sql``, which may go on with a comma; None where SQL
    cannot express the query."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {shared}{'' if sql.lstrip().startswith(',') else ' '}{sql}" if shared else sql
        return f

    return add
