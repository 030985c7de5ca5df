"""All registered queries."""

from nightjar.plans import queries_cases, queries_detect, queries_events, queries_graph, queries_ingest, queries_intel, queries_reports, queries_rulepack, queries_sources, queries_streams  # noqa: F401
from nightjar.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
