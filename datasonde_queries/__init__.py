"""Registered queries over the given tables and the SQL each is checked against."""

from datasonde_queries import charts, drill, findings, plan, profile, sources  # noqa: F401
from datasonde_queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
