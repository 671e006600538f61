"""Queries over the given tables, one per operator, with SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = ("sources", "profile", "eda", "metrics", "split", "features", "registry", "models", "model_values")


def load_catalog() -> None:
    """Import every catalog module, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"tablewright.catalog.{name}")
