"""Registered queries over the test tables, each beside its SQL statement of the same result."""

from __future__ import annotations

import importlib

MODULES = ("pivoting", "profiling", "reconciling", "associating", "forecasting", "clustering", "reporting")


def _collect(name: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        found = getattr(importlib.import_module(f"queries.{module}"), name)
        repeated = merged.keys() & found.keys()
        if repeated:
            raise ValueError(f"Registered twice: {sorted(repeated)}")
        merged.update(found)
    return merged


def all_queries() -> dict:
    return _collect("QUERIES")


def all_sql() -> dict:
    return _collect("SQL")
