"""Registered jobs over the driver tables and their DuckDB oracles."""

from tracefold.plans import q_contracts, q_decisions, q_gates, q_graph, q_judging, q_plugins, q_text, q_traces  # noqa: F401  (registers queries)
from tracefold.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
