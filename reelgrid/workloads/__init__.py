"""Registered queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("timeline", "search", "scoring", "evaluation", "bookkeeping", "files", "flows", "streams")


def load() -> tuple[dict, dict]:
    """All queries and all checking SQL, by name."""
    for module in _MODULES:
        import_module(f"reelgrid.workloads.{module}")
    from reelgrid.workloads.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
