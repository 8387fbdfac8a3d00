"""Grouping sets: rollup, cube, totals. Rolled-up keys are null; ``level`` tells them from null keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(rows: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    return rows.rollup(*keys).agg(*aggregates, F.grouping_id().cast("long").alias("level"))


def cube(rows: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    return rows.cube(*keys).agg(*aggregates, F.grouping_id().cast("long").alias("level"))


def totals(rows: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """The groups and one grand total, in one pass."""
    sets = [[F.col(k) for k in keys], []]
    return rows.groupingSets(sets, *keys).agg(*aggregates, F.grouping_id().cast("long").alias("level"))
