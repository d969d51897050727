"""Registered queries and their SQL."""

from tallymark.plans import rollup_queries, source_queries, telemetry_queries, text_queries, trial_queries  # noqa: F401
from tallymark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
