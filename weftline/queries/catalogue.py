"""All registered queries."""

from __future__ import annotations

import importlib

from weftline.queries.registry import ORACLES, QUERIES

MODULES = ("scans", "reads", "measures", "changes", "fields", "jobs")

for _name in MODULES:
    importlib.import_module(f"weftline.queries.{_name}")

__all__ = ["ORACLES", "QUERIES"]
