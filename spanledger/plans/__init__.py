"""Named queries over the given tables, with reference SQL where it exists."""

from __future__ import annotations

import importlib
from types import ModuleType

_MODULES = ("trace_queries", "cost_queries", "standards_queries", "governance_queries", "stream_queries")


def load() -> ModuleType:
    """Import every query module and return the registry."""
    for name in _MODULES:
        importlib.import_module(f"spanledger.plans.{name}")
    return importlib.import_module("spanledger.plans.registry")
