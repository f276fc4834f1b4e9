"""Registration of catalog queries beside the SQL that they must equal."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[Callable, dict[str, Callable], dict[str, str]]:
    """A decorator ``query(sql, *views)``, and what it has registered: functions and SQL by name."""
    queries: dict[str, Callable] = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None, *views: str) -> Callable:
        def register(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql is not None:
                sqls[f.__name__] = ("with " + ", ".join(views) + " " if views else "") + sql
            return f

        return register

    return query, queries, sqls
