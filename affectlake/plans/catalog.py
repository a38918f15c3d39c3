"""All registered queries."""

from affectlake.plans import (  # noqa: F401
    file_queries, model_queries, score_queries, table_queries, text_queries,
)
from affectlake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
