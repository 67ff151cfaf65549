"""Importing the query modules fills the registry."""

from cleanloom.queries import cleaning, scoring, search, series, transfer  # noqa: F401
from cleanloom.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
