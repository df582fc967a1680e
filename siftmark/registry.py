"""Queries by name, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """`sql` with the definitions of the catalog's views that it names, in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.IGNORECASE)
    if head:
        return f"WITH {head[1] or ''}{views}, {sql[head.end():]}"
    return f"WITH {views} {sql}"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under `name`, and its SQL if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add
