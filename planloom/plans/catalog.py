"""All registered queries with their SQL equivalents."""

from __future__ import annotations

from planloom.plans import cloud_queries, kernel_queries, path_queries, plan_queries, wall_queries  # noqa: F401
from planloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
