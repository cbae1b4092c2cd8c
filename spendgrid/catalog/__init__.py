"""Registered queries over the driver's tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("analytics_queries", "text_queries", "model_queries", "grouping_queries", "record_queries")


def _merged(attribute: str) -> dict:
    merged = {}
    for name in _MODULES:
        merged.update(getattr(import_module(f"spendgrid.catalog.{name}"), attribute))
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
