"""Registration of queries and composition of their check SQL from shared CTEs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from registry.tables import CTES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL of the same result if there is one."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = with_ctes(sql)
        return function

    return register


def with_ctes(body: str) -> str:
    """Prefix a statement with the shared CTEs that it uses, directly or not."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(definition)

    visit(body)
    parts = [f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed]
    body = body.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def even(expression: str, digits: int = 0) -> str:
    """SQL for half-even rounding of a double by its shortest decimal form."""
    return f"CAST(round_even(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38, 17)), {digits}) AS DOUBLE)"


def safe_ratio(a: str, b: str) -> str:
    """SQL for a / b in doubles, null when b is 0."""
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def strict(column: str) -> str:
    """SQL for a sum that is null when an addend is."""
    return f"CASE WHEN count({column}) = count(*) THEN sum({column}) END"
