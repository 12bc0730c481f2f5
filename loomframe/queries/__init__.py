"""Queries over the star-schema tables, one or more per operator, each with its SQL."""

from loomframe.queries import groups, matching, reports, shaping, sliding  # noqa: F401
from loomframe.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
