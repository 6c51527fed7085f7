"""Query registry: each entry pairs a Spark plan with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def quote(text: str) -> str:
    """SQL string literal for the checking engine."""
    return "'" + text.replace("'", "''") + "'"


def quoted_list(items) -> str:
    return "[" + ", ".join(quote(i) for i in items) + "]"
