"""All registered queries by name."""

from __future__ import annotations

import importlib

MODULES = ["search", "graphs", "texts", "changes", "sources"]


def all_queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(importlib.import_module(f"codequarry.registered.{module}").QUERIES)
    return found
