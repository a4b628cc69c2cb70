"""Registered queries and their DuckDB SQL."""

from ledgerloom.plans import (  # noqa: F401  they register themselves
    compare_queries,
    layout_queries,
    profile_queries,
    quality_queries,
    relational_queries,
    rule_queries,
    streaming_queries,
    structure_queries,
    syntax_queries,
    text_queries,
)
from ledgerloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
