"""Queries by name, each with the SQL that an oracle engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from streammart.plans.entities import SQL, Entities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None):
    """Decorates a function of the entities; ``sql`` follows their common table expressions."""

    def add(build: Callable[[Entities], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Entities(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {SQL.strip()}\n{sql}"
        return build

    return add
