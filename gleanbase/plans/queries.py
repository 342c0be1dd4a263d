"""All example queries."""

from . import block_queries, text_queries, vector_queries  # noqa: F401  (they register themselves)
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
