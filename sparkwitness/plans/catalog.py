"""All registered queries of the evidence operators and their SQL."""

from __future__ import annotations

from . import change_queries, decision_queries, graph_queries, history_queries, measure_queries, planning_queries, release_queries, scalar_queries, source_queries, telemetry_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
