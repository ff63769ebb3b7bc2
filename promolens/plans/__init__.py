"""The registered queries and their SQL oracles."""

from . import more_queries, queries, table_queries

__all__ = ["more_queries", "queries", "table_queries"]
