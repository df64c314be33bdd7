"""Registered queries: every operator over the given tables, with the SQL that checks it."""

from __future__ import annotations

import importlib

from codestrata.catalog.registry import ORACLES, QUERIES, Tables

for _module in ("texts", "tables", "reshaping", "metrics", "ranking", "splits", "learning"):
    importlib.import_module(f"codestrata.catalog.{_module}")

__all__ = ["ORACLES", "QUERIES", "Tables"]
