"""Registration of queries and composition of their SQL statements."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from trialkit.registry.views import VIEW_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _with_needed(names: Sequence[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        needs, _ = VIEW_SQL[name]
        for n in [*_with_needed(needs), name]:
            if n not in out:
                out.append(n)
    return out


def compose(views: Sequence[str], body: str) -> str:
    """Prefix a statement with the views it reads."""
    body = body.strip()
    named = ", ".join(f"{n} AS ({VIEW_SQL[n][1].strip()})" for n in _with_needed(views))
    if not named:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{named}, {body[len(head):]}"
    return f"WITH {named} {body}"


def query(name: str, sql: str | None = None, views: Sequence[str] = ()) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = compose(views, sql)
        return fn

    return register
