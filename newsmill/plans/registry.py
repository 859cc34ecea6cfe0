"""Registry of runnable queries and their DuckDB oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsmill.plans.fixtures import DUCK

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_NAMES = re.compile(r"\b(" + "|".join(DUCK) + r")\b")
_WITH = re.compile(r"^\s*with\s+(recursive\s+)?", re.I)


def _needed(sql: str, seen: list[str]) -> None:
    for name in _NAMES.findall(sql):
        if name not in seen:
            _needed(DUCK[name], seen)
            if name not in seen:
                seen.append(name)


def oracle(sql: str) -> str:
    """Put the fixture views a statement uses in front of it as CTEs."""
    order: list[str] = []
    _needed(sql, order)
    head = _WITH.match(sql)
    body = sql[head.end():] if head else sql
    recursive = "recursive " if head and head.group(1) else ""
    ctes = [f"{n} as ({DUCK[n]})" for n in order]
    if not ctes:
        return sql
    sep = ",\n" if head else "\n"
    return f"with {recursive}" + ",\n".join(ctes) + sep + body


def query(key: str, sql: str | None = None):
    """Register a query; ``sql`` is its oracle when SQL can express it."""

    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = oracle(sql)
        return fn

    return register
