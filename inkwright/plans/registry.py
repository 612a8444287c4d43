"""All queries by name, gathered from the plan modules."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}
for _name in ("pages", "quality", "readings", "checks", "boxes", "rendering", "streams", "derived"):
    _module = import_module(f"inkwright.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
