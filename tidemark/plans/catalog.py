"""All registered queries."""

from tidemark.plans import frame_queries, metric_queries, model_queries, source_queries, state_queries  # noqa: F401
from tidemark.plans.registry import ORACLE, QUERIES  # noqa: F401
