"""All registered queries."""

from dayloom.plans import queries_aggregate, queries_effects, queries_sequences, queries_shape  # noqa: F401
from dayloom.plans.registry import QUERIES, oracle_text, runner

__all__ = ["QUERIES", "oracle_text", "runner"]
