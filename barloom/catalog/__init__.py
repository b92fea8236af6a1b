"""Every operator bound to the given tables, with its equivalent SQL."""

from __future__ import annotations

import importlib

_SECTIONS = (
    "scans",
    "predicates",
    "joins",
    "aggregates",
    "dashboards",
    "rolling",
    "ranking",
    "paging",
    "dedup",
    "scalars",
    "spines",
    "nested",
    "jobs",
)


def load_all():
    """Import every section and return (queries, sql)."""
    from barloom.catalog import registry

    for s in _SECTIONS:
        importlib.import_module(f"barloom.catalog.{s}")
    return dict(registry.QUERIES), dict(registry.SQL)
