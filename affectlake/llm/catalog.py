"""All queries of the package."""

from affectlake.llm import corpus_queries, mix_queries, near_queries, page_queries, text_queries  # noqa: F401
from affectlake.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
