"""Registration of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that DuckDB answers alike (none: checked by tests)."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def bounded(pattern: str) -> str:
    """A pattern whose word bounds count letters beyond ASCII, for an engine whose own don't."""
    return re.sub(r"\\b(?=[a-z(])", r"(?:^|[^\\pL\\pN_])", pattern).replace(r"\b", r"(?:$|[^\pL\pN_])")


def ladder_sql(column: str, patterns: dict[str, str], otherwise: str) -> str:
    patterns = {k: bounded(p) for k, p in patterns.items()}
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{k}'" for k, p in patterns.items()) + f" ELSE '{otherwise}' END"
