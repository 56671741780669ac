"""Operators for training data.  Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

MODULES = ("overlap", "matching", "grouping", "packing", "mixing", "spans")


def query_modules() -> list:
    """The modules that hold queries and reference SQL."""
    return [importlib.import_module(f"wetlens.llm.{name}") for name in MODULES]
