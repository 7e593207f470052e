"""Named queries over the benchmark tables, each with its SQL equivalent when one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.sources.sample_ledger import SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_views(views: str, body: str) -> str:
    """Prefix ``body`` (which may open with its own ``WITH``) with the named ledger CTEs."""
    parts = [SQL[name].strip() for name in views.split()]
    text = body.strip()
    recursive = False
    if text.upper().startswith("WITH RECURSIVE "):
        recursive, text = True, text[len("WITH RECURSIVE ") :]
        parts.append("")
    elif text.upper().startswith("WITH "):
        text = text[len("WITH ") :]
        parts.append("")
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not views:
        return body.strip()
    joined = ",\n".join(p for p in parts if p)
    return head + joined + (",\n" if parts[-1] == "" else "\n") + text


def query(name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``views`` names the ledger CTEs its SQL reads."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return register
