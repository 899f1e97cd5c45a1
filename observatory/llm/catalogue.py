"""Every query of the subpackage."""

from __future__ import annotations

from observatory.llm import queries
from observatory.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries"]
