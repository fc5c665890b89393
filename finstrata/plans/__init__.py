"""Registered queries over the test tables and their SQL oracles."""

from __future__ import annotations

import importlib

MODULES = ["sources", "etl", "samples", "features", "profiles", "metrics", "statistics", "audit", "models",
           "resampling", "validation", "explanation"]


def load():
    """Import every query module once and return (queries, oracles)."""
    from . import registry

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return registry.QUERIES, registry.ORACLES
