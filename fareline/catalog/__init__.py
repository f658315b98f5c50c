"""Registered queries: each operator over the given tables, with its SQL counterpart."""

from __future__ import annotations

from fareline.catalog import modelling, quality, reporting, sampling, trips, workload
from fareline.catalog.registry import Query

MODULES = (trips, workload, sampling, reporting, quality, modelling)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for name, query in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query registered twice: {name}")
            found[name] = query
    return found
