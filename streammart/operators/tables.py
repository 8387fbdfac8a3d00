"""Merge-on-key tables: replacing, summing, deleting, upserting, as whole-table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streammart.operators.ingest import latest


def replacing(rows: DataFrame, keys: list[str], version: str, *arrival) -> DataFrame:
    """The row of each key with the greatest version, of equal ones the last to arrive."""
    return latest(rows, keys, F.desc(version), *arrival)


def summing(rows: DataFrame, keys: list[str], sums: list[str], firsts: list[str] = ()) -> DataFrame:
    """Sums per key; other columns keep the least value, so that merges in any order agree."""
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in firsts))


def delete_where(rows: DataFrame, condition) -> DataFrame:
    """Rows for which the condition is false or null."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return rows.filter(~F.coalesce(c, F.lit(False)))


def upsert(table: DataFrame | None, changes: DataFrame, key: str, *order, keep_deletes: bool = False) -> DataFrame:
    """``table`` after ``changes`` (columns of the table, and type): the last change per key wins.

    ``keep_deletes`` writes the image of a deleted row instead of removing it.
    """
    last = latest(changes, [key], *order)
    columns = [c for c in (table if table is not None else last.drop("type")).columns if c != "type"]
    written = (last if keep_deletes else last.filter("type != 'delete'")).select(*columns)
    if table is None:
        return written
    return table.join(last.select(key), key, "left_anti").select(*columns).unionByName(written)
