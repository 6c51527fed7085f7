"""Importing this module registers every query."""

from __future__ import annotations

import importlib

from tidewright.plans.registry import ORACLES, QUERIES

for _module in ("storage", "relational", "windows", "scalars", "changes", "scripts", "privacy", "review", "cards", "pairs", "retrieval", "evaluation", "streams"):
    importlib.import_module(f"tidewright.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
