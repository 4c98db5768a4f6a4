"""Registered queries over the driver tables, each beside the SQL that checks it."""

from registry.catalog import ORACLE, QUERIES
from registry import cleaning, portfolio, relations, scalars, scans, study, usage  # noqa: F401  (register)

__all__ = ["ORACLE", "QUERIES"]
