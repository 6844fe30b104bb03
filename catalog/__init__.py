"""Registered queries over the driver's tables, each with its SQL oracle."""

from __future__ import annotations

import importlib

_MODULES = ("q_listings", "q_matching", "q_crawl", "q_scalars", "q_merge", "q_sources",
            "q_profiles")


def load() -> None:
    """Import every query module; importing registers its queries."""
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
