"""All registered queries on detection data."""

from boxwise.plans import boxes_queries, mask_queries, model_queries, pipeline_queries, stream_queries, table_queries  # noqa: F401
from boxwise.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
