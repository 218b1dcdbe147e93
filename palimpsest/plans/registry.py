"""The engine's registered queries."""

from palimpsest.plans import layout_queries, section_queries, table_queries  # noqa: F401
from palimpsest.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
