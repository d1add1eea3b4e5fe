"""Queries over the test tables, one per operator."""

from __future__ import annotations

from importlib import import_module

GROUPS = (
    "population", "profiles", "events", "market", "shaping", "loading", "clustering", "identity", "neighbours"
)


def load():
    """Import every query module and return the registry."""
    for group in GROUPS:
        import_module(f"levelfield.plans.{group}")
    return import_module("levelfield.plans.registry")
