"""Registered queries: input derivations, query definitions, oracles."""

from importlib import import_module

_MODULES = [
    "reader_queries",
    "text_queries",
    "collect_queries",
    "lifecycle_queries",
    "evaluation_queries",
    "dedup_queries",
    "digest_queries",
    "search_queries",
    "table_queries",
    "file_queries",
]


def load():
    """Import every query module and return the filled registry."""
    for name in _MODULES:
        import_module(f"newsmill.plans.{name}")
    return import_module("newsmill.plans.registry")
