"""Search words: filter, tokenize, weigh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streammart.functions.tokenize import words

#: What a word's source counts for; others count nothing.
WEIGHTS = {"SEARCH": 10, "ORDER": 3, "CART": 2, "CLICK": 1}


def searched(pages: DataFrame, page_id: str = "good_list") -> DataFrame:
    """ts, fullword of pages of one kind that carry an item; ``page`` is a map or a struct."""
    return pages.filter((F.col("page")["page_id"] == page_id) & F.col("page")["item"].isNotNull()).select(
        "ts", F.col("page")["item"].alias("fullword")
    )


def tokenized(rows: DataFrame, column: str = "fullword") -> DataFrame:
    """One row per token (an inner lateral join: texts without a token give none)."""
    return rows.withColumn("keyword", F.explode(words(F.col(column))))


def weighted(stats: DataFrame, n: int) -> DataFrame:
    """keyword and weighted count of the n words with the greatest UNWEIGHTED count; ties by keyword."""
    weight = F.lit(0)
    for source, w in WEIGHTS.items():
        weight = F.when(F.col("source") == source, w).otherwise(weight)
    totals = stats.groupBy("keyword").agg(F.sum(F.col("ct") * weight).alias("ct"), F.sum("ct").alias("_n"))
    return totals.orderBy(F.desc("_n"), "keyword").limit(n).drop("_n")
