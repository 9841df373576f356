"""Import every query module so that the registry is full."""

from __future__ import annotations

from codeloom.plans import data_queries, rewrite_queries, score_queries, text_queries  # noqa: F401
from codeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
