"""Promotions: matching, rule choice, allocation of reductions, order totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def matching_coupons(details: DataFrame, coupons: DataFrame) -> DataFrame:
    """Every (detail, coupon) of a user whose range names the detail's category, trademark or spu."""
    named = lambda kind, c: (F.col("range_type") == kind) & (F.col("range_id") == F.col(c))
    held = coupons.withColumnRenamed("user_id", "coupon_user_id")
    return details.join(
        held,
        (F.col("user_id") == F.col("coupon_user_id")) & (named("3301", "category3_id") | named("3302", "tm_id") | named("3303", "spu_id")),
    ).drop("coupon_user_id")


def matching_activities(details: DataFrame, activity_skus: DataFrame) -> DataFrame:
    return details.join(activity_skus, "sku_id")


def promotion_sums(matched: DataFrame, key: str, amount: str, number: str, item: str) -> DataFrame:
    """Per promotion: amount, quantity and the items it covers."""
    return matched.groupBy(key).agg(
        F.sum(amount).alias("amount"), F.sum(number).alias("quantity"), F.array_sort(F.collect_set(item)).alias("items")
    )


def best_rule(sums: DataFrame, rules: DataFrame, key: str, later_wins: bool = True) -> DataFrame:
    """The rule of the greatest benefit level whose condition the sums meet; ties by rule id."""
    met = sums.join(rules, key).filter((F.col("amount") >= F.col("condition_amount")) & (F.col("quantity") >= F.col("condition_num")))
    tie = F.desc("rule_id") if later_wins else F.asc("rule_id")
    w = W.partitionBy(key).orderBy(F.desc("benefit_level"), tie)
    return met.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def allocate(rows: DataFrame, key: str, total: Column, amount: str, name: str, *order) -> DataFrame:
    """Splits ``total`` over a key's rows in proportion, half up to cents; the last row takes the rest."""
    whole = W.partitionBy(key)
    ranked = W.partitionBy(key).orderBy(*order)
    share = F.when(
        F.sum(amount).over(whole) == 0, F.lit(0)
    ).otherwise(F.round(total * F.col(amount) / F.sum(amount).over(whole), 2)).cast("decimal(16,2)")
    cut = rows.withColumns({"_share": share, "_n": F.row_number().over(ranked), "_of": F.count("*").over(whole)})
    before = F.coalesce(F.sum("_share").over(ranked.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = F.when(F.col("_n") == F.col("_of"), total - before).otherwise(F.col("_share")).cast("decimal(16,2)")
    return cut.withColumn(name, part).drop("_share", "_n", "_of")


def order_totals(details: DataFrame) -> DataFrame:
    """Order totals from details: reductions and freight are counted once."""
    d = details.groupBy("order_id").agg(
        F.sum(F.col("order_price") * F.col("sku_num")).cast("decimal(16,2)").alias("original_total_amount"),
        F.sum("activity_amount").cast("decimal(16,2)").alias("activity_reduce_amount"),
        F.sum("coupon_amount").cast("decimal(16,2)").alias("coupon_reduce_amount"),
        F.sum("freight").cast("decimal(16,2)").alias("feight_fee"),
    )
    total = F.col("original_total_amount") - F.col("activity_reduce_amount") - F.col("coupon_reduce_amount") + F.col("feight_fee")
    return d.withColumn("total_amount", total.cast("decimal(16,2)"))


def order_subjects(details: DataFrame, *order: str) -> DataFrame:
    """The first item's name and how many pieces the order has."""
    return details.groupBy("order_id").agg(
        F.concat(F.min_by("sku_name", F.struct(*order)), F.lit(" and others, "), F.sum("sku_num").cast("string"), F.lit(" pieces")).alias("subject")
    )


def spaced_times(actions: DataFrame, key: str, start: str, duration: str, *order) -> DataFrame:
    """Times that divide each page's duration evenly: start + n * floor(duration / (count + 1))."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    step = F.floor(F.col(duration) / (F.count("*").over(W.partitionBy(key)) + 1))
    return actions.withColumn("action_ts", F.col(start) + n * step)
