"""All registered plans."""

from __future__ import annotations

from recordspine.plans import claims, decisions, integrity, officials, operations, pages, health, intervals, matching, planning, records, rosters, routing, submissions, trees, universe, writes  # noqa: F401  registers
from recordspine.plans.registry import SQL, spark_queries


def queries():
    return spark_queries()


def oracle_sql():
    return dict(SQL)
