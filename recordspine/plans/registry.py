"""Queries by name, each with the SQL that DuckDB runs on the same Parquet files."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordspine.plans.views import VIEWS, Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its own name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql)
        return f

    return keep


def with_views(sql: str) -> str:
    """sql behind the definitions of the fixture views that it names."""
    used = [v for v in VIEWS if re.search(rf"\bfx_{v}\b", sql)]
    if not used:
        return sql
    head = ",\n".join(f"fx_{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    recursive = bool(re.match(r"WITH RECURSIVE\b", body))
    if body.startswith("WITH"):
        body = ",\n" + re.sub(r"^WITH( RECURSIVE)?\s", "", body, count=1)
    return f"WITH {'RECURSIVE ' * recursive}{head}\n{body}"


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in QUERIES.items()}
