"""Registered queries of the core (problems 1-5 and the inventory's operators) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from gridloom.queries import inventory, problems

    return inventory.QUERIES | problems.QUERIES


def all_sql() -> dict[str, str]:
    from gridloom.queries import inventory_sql, problems_sql

    return inventory_sql.SQL | problems_sql.SQL
