"""All named queries."""
from leakscope.plans import detection_queries, score_queries, source_queries, state_queries  # noqa: F401
from leakscope.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
