"""Every registered query with its SQL twin."""

from __future__ import annotations

from importlib import import_module

MODULES = ["alignment", "manifests", "layout", "naming", "tagging", "catalogue", "events", "readers"]


def all_queries() -> dict:
    found = {}
    for name in MODULES:
        found.update(import_module(f"tapeledger.plans.{name}").QUERIES)
    return found
