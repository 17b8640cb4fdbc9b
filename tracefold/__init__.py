"""tracefold: agent-decision telemetry analytics on Spark.

Typed, privacy-gated datasets from agent traces and log records: attribute
allowlists, keyed redaction, policy predicates and deterministic sampling;
per-decision folds; a provenance graph; red-team roll-ups; judge scoring and
escalation routing; usage, cost and receipt accounting. Batch and streaming.
"""

__version__ = "0.1.0"
