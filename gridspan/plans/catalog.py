"""All registered queries of the engine."""

from . import formula_queries, table_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "formula_queries", "table_queries"]
