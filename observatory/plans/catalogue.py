"""Every registered query."""

from __future__ import annotations

import importlib

from observatory.plans.registry import ORACLES, QUERIES

MODULES = ("sightings", "camera", "places", "records", "streams", "details", "landed")

for _m in MODULES:
    importlib.import_module(f"observatory.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]
