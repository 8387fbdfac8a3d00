"""Tumbling-window statistics: sparse metric rows, united, then aggregated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streammart.functions.scalars import empty, second_text

VISITOR_KEYS = ["vc", "ch", "ar", "is_new"]
VISITOR_METRICS = ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]
PRODUCT_COUNTS = ["display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num", "comment_ct", "good_comment_ct"]
PRODUCT_AMOUNTS = ["order_amount", "payment_amount", "refund_amount"]
PRODUCT_SETS = {"order_ct": "order_id", "paid_order_ct": "paid_order_id", "refund_order_ct": "refund_order_id"}
GOOD = "1201"


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _visitor(rows: DataFrame, **metrics) -> DataFrame:
    return rows.select("ts", *VISITOR_KEYS, *(metrics.get(m, F.lit(0)).cast("long").alias(m) for m in VISITOR_METRICS))


def visitor_rows(pages: DataFrame, unique: DataFrame, bounced: DataFrame) -> DataFrame:
    """Page views (with sessions and durations), unique visits and bounces as one metric stream."""
    session = F.when(empty("last_page_id"), 1).otherwise(0)
    viewed = _visitor(pages, pv_ct=F.lit(1), sv_ct=session, dur_sum=F.coalesce("during_time", F.lit(0)))
    return union_all(viewed, _visitor(unique, uv_ct=F.lit(1)), _visitor(bounced, uj_ct=F.lit(1)))


def _windowed(rows: DataFrame, size: str, keys: list, aggregates: list[Column]) -> DataFrame:
    w = F.window("ts", size)
    return (
        rows.groupBy(w.alias("w"), *keys)
        .agg(*aggregates)
        .select(second_text("w.start").alias("stt"), second_text("w.end").alias("edt"), "*")
        .drop("w")
    )


def visitor_stats(rows: DataFrame, size: str) -> DataFrame:
    return _windowed(rows, size, VISITOR_KEYS, [F.sum(m).alias(m) for m in VISITOR_METRICS])


def product_rows(rows: DataFrame, sku: Column, **metrics) -> DataFrame:
    """Rows of one source in the sparse product schema; metrics not given are 0, sets null."""
    return rows.select(
        "ts",
        sku.cast("long").alias("sku_id"),
        *(F.coalesce(metrics.get(m, F.lit(0)), F.lit(0)).cast("long").alias(m) for m in PRODUCT_COUNTS),
        *(F.coalesce(metrics.get(m, F.lit(0)), F.lit(0)).cast("decimal(16,2)").alias(m) for m in PRODUCT_AMOUNTS),
        *(metrics.get(m, F.lit(None)).cast("long").alias(m) for m in PRODUCT_SETS.values()),
    )


def click_and_display(log: DataFrame) -> DataFrame:
    """Of a page event: a click if it is a product's page, and a display per product shown."""
    clicks = product_rows(log.filter("page.page_id = 'good_detail' and page.item is not null"), F.col("page.item"), click_ct=F.lit(1))
    shown = log.select("ts", F.explode("displays").alias("d")).filter("d.item_type = 'sku_id'")
    return union_all(clicks, product_rows(shown, F.col("d.item"), display_ct=F.lit(1)))


def favor_rows(favors: DataFrame) -> DataFrame:
    return product_rows(favors, F.col("sku_id"), favor_ct=F.lit(1))


def cart_rows(carts: DataFrame) -> DataFrame:
    return product_rows(carts, F.col("sku_id"), cart_ct=F.lit(1))


def order_rows(orders: DataFrame) -> DataFrame:
    return product_rows(orders, F.col("sku_id"), order_sku_num=F.col("sku_num"), order_amount=F.col("amount"), order_id=F.col("order_id"))


def payment_rows(payments: DataFrame) -> DataFrame:
    return product_rows(payments, F.col("sku_id"), payment_amount=F.col("amount"), paid_order_id=F.col("order_id"))


def refund_rows(refunds: DataFrame) -> DataFrame:
    return product_rows(refunds, F.col("sku_id"), refund_amount=F.col("amount"), refund_order_id=F.col("order_id"))


def comment_rows(comments: DataFrame) -> DataFrame:
    good = F.when(F.col("appraise") == GOOD, 1).otherwise(0)
    return product_rows(comments, F.col("sku_id"), comment_ct=F.lit(1), good_comment_ct=good)


def product_stats(rows: DataFrame, size: str) -> DataFrame:
    """Sums and numbers of distinct orders per product and window (distinct even for single rows).

    A batch sums per distinct order first, so no row is multiplied for the three distinct counts; a
    stream has one aggregation only, where the sets are collected and measured.
    """
    if rows.isStreaming:
        sums = [F.sum(m).alias(m) for m in [*PRODUCT_COUNTS, *PRODUCT_AMOUNTS]]
        sets = [F.size(F.collect_set(c)).cast("long").alias(m) for m, c in PRODUCT_SETS.items()]
        return _windowed(rows, size, ["sku_id"], [*sums, *sets])
    ids = F.array(*(F.struct(F.lit(m).alias("set"), F.col(c).alias("id")) for m, c in PRODUCT_SETS.items()))
    metrics = [*PRODUCT_COUNTS, *PRODUCT_AMOUNTS]
    placed = rows.select("ts", "sku_id", *metrics, F.posexplode_outer(F.filter(ids, lambda x: x["id"].isNotNull())).alias("_n", "_order"))
    # A row with several orders stands once for each; its metrics count with the first.
    counted = [F.when(F.coalesce("_n", F.lit(0)) == 0, F.col(m)).alias(m) for m in metrics]
    w = F.window("ts", size).alias("w")
    per_order = placed.select("ts", "sku_id", "_order", *counted).groupBy(w, "sku_id", "_order").agg(*(F.sum(m).alias(m) for m in metrics))
    totals = [F.sum(m).alias(m) for m in PRODUCT_COUNTS] + [F.sum(m).cast("decimal(26,2)").alias(m) for m in PRODUCT_AMOUNTS]
    distinct = [F.count_if(F.col("_order.set") == m).alias(m) for m in PRODUCT_SETS]
    return (
        per_order.groupBy("w", "sku_id")
        .agg(*totals, *distinct)
        .select(second_text("w.start").alias("stt"), second_text("w.end").alias("edt"), "*")
        .drop("w")
    )


def province_stats(orders: DataFrame, size: str) -> DataFrame:
    """Order amount and distinct orders per province and window."""
    keys = ["province_id", "province_name", "area_code", "iso_code", "iso_3166_2"]
    count = F.size(F.collect_set("order_id")).cast("long") if orders.isStreaming else F.count_distinct("order_id")
    return _windowed(orders, size, keys, [F.sum("split_total_amount").alias("order_amount"), count.alias("order_count")])


def keyword_stats(words: DataFrame, size: str, source: str = "SEARCH") -> DataFrame:
    return _windowed(words, size, ["keyword"], [F.count("*").alias("ct")]).withColumn("source", F.lit(source))
