"""Registered queries; ``load_all`` imports every query module and returns queries and SQL checks."""

from __future__ import annotations

import importlib
import importlib.util

from cairnfield.plans import registry

MODULES = (
    "catalog_queries",
    "vector_queries",
    "text_queries",
    "facet_queries",
    "policy_queries",
    "journal_queries",
    "stream_queries",
    "capability_queries",
    "insight_queries",
)


def load_all() -> tuple[dict[str, registry.Query], dict[str, str]]:
    for name in MODULES:
        if importlib.util.find_spec(f"{__name__}.{name}") is None:
            continue
        importlib.import_module(f"{__name__}.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
