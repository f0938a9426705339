"""The library's tables as views over raw data, and the named queries over them."""

from . import analysis, details, extras, queries, stores
from .registry import oracle_sql
from .registry import queries as all_queries

__all__ = ["all_queries", "analysis", "details", "extras", "oracle_sql", "queries", "stores"]
