"""Collects the query modules."""

from __future__ import annotations

import importlib

from attesta.plans import registry

MODULES = ["text_queries", "evidence_queries", "retrieval_queries", "identity_queries", "validation_queries", "compare_queries", "rollup_queries", "export_queries", "streaming_queries"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"attesta.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def checks():
    _load()
    return dict(registry.CHECKS)
