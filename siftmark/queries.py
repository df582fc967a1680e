"""All queries of the library: importing the operator modules registers them."""

from __future__ import annotations

from .operators import analytics, codegraph, context, graph, logs, procedures, retrieval, review, scalars, streams  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
