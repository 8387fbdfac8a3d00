"""Visitor state as window functions over whole histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streammart.functions.scalars import day_key, empty


def repair_new_visitors(pages: DataFrame, *order) -> DataFrame:
    """A device that claims to be new after the first day it did so is set to ``is_new = '0'``.

    Rows with is_new other than '1' neither read nor set the first day.
    """
    w = W.partitionBy("mid").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.first(F.when(F.col("is_new") == "1", day_key("ts")), ignorenulls=True).over(w)
    fixed = F.when((F.col("is_new") == "1") & (day_key("ts") != first), "0").otherwise(F.col("is_new"))
    return pages.withColumn("is_new", fixed)


def unique_visits(pages: DataFrame, *order) -> DataFrame:
    """The first page without a predecessor of each device and day."""
    w = W.partitionBy("mid", day_key("ts")).orderBy(*order)
    return pages.filter(empty("last_page_id")).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def bounces(pages: DataFrame, limit: str, *order) -> DataFrame:
    """First pages that no page of the device follows within ``limit``; an interval literal."""
    w = W.partitionBy("mid").orderBy(*order)
    after: Column = F.lead("ts").over(w)
    late = after.isNull() | (after >= F.col("ts") + F.expr(f"INTERVAL {limit}"))
    return pages.withColumn("_late", late).filter(F.col("_late") & empty("last_page_id")).drop("_late")
