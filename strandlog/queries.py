"""The queries of the event log."""

from .plans.catalogue import flagship, oracle_sql, queries

__all__ = ["flagship", "oracle_sql", "queries"]
