"""Dashboard queries over statistics tables, and their reshaping to JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streammart.functions.scalars import bounce_rate, day_number, dwell_seconds, hour_label, pages_per_session


def on_day(stats: DataFrame, day: int, column: str = "stt") -> DataFrame:
    """Rows whose window starts on day yyyyMMdd. A ``dt`` partition column, if there is one, prunes."""
    rows = stats.filter(F.col("dt") == day) if "dt" in stats.columns else stats
    return rows.filter(day_number(column) == day)


def gmv(stats: DataFrame) -> DataFrame:
    return stats.agg(F.sum("order_amount").alias("order_amount"))


def top_groups(stats: DataFrame, key: str, n: int, *more) -> DataFrame:
    """The n greatest groups by order amount, positive ones only; ties by key."""
    grouped = stats.groupBy(key).agg(F.sum("order_amount").alias("order_amount"), *more)
    return grouped.filter("order_amount > 0").orderBy(F.desc("order_amount"), key).limit(n)


def by_province(stats: DataFrame) -> DataFrame:
    return stats.groupBy("province_name").agg(F.sum("order_amount").alias("order_amount"))


def visitors_by_flag(stats: DataFrame) -> DataFrame:
    return stats.groupBy("is_new").agg(*(F.sum(c).alias(c) for c in ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")))


def visitors_by_hour(stats: DataFrame) -> DataFrame:
    return stats.groupBy(F.hour("stt").alias("hr")).agg(
        F.sum("uv_ct").alias("uv_ct"),
        F.sum("pv_ct").alias("pv_ct"),
        F.sum(F.when(F.col("is_new") == "1", F.col("uv_ct")).otherwise(0)).alias("new_uv"),
    )


def every_hour(by_hour: DataFrame) -> DataFrame:
    """24 rows with labels 00 to 23, absent hours zero."""
    hours = by_hour.sparkSession.range(24).select(F.col("id").cast("int").alias("hr"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in by_hour.columns if c != "hr"}
    return hours.join(by_hour, "hr", "left").withColumns(zero).withColumn("hr", hour_label("hr"))


def rates(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*",
        bounce_rate("uj_ct", "sv_ct").alias("uj_rate"),
        dwell_seconds("dur_sum", "sv_ct").alias("dur_per_sv"),
        pages_per_session("pv_ct", "sv_ct").alias("pv_per_sv"),
    )


def visitor_pivot(stats: DataFrame) -> DataFrame:
    """Five measures with a column for new and for returning visitors; an absent side is zero."""
    measured = rates(visitors_by_flag(stats))
    fields = {"uv": "uv_ct", "pv": "pv_ct", "bounce": "uj_rate", "dwell": "dur_per_sv", "pages": "pv_per_sv"}
    long = measured.select("is_new", F.explode(F.create_map(*[x for n, c in fields.items() for x in (F.lit(n), F.col(c).cast("double"))])).alias("measure", "value"))
    pick = lambda flag: F.coalesce(F.max(F.when(F.col("is_new") == flag, F.col("value"))), F.lit(0.0))
    return long.groupBy("measure").agg(pick("1").alias("new_visitors"), pick("0").alias("old_visitors"))


# Reshaping: one row with a JSON text


def _reply(rows: DataFrame, data) -> DataFrame:
    return rows.agg(data.alias("data")).select(F.to_json(F.struct(F.lit(0).alias("status"), "data")).alias("json"))


def _all(*fields):
    return F.array_sort(F.collect_list(F.struct(*fields)))


def series_json(top: DataFrame, key: str) -> DataFrame:
    """Parallel arrays: categories and one series, greatest first. ``top`` is a limited result."""
    rows = _all((-F.col("order_amount")).alias("k"), F.col(key).alias("name"), F.col("order_amount").alias("value"))
    names = F.transform(rows, lambda r: r["name"])
    values = F.transform(rows, lambda r: r["value"])
    return _reply(top, F.struct(names.alias("categories"), F.array(F.struct(F.lit(key).alias("name"), values.alias("data"))).alias("series")))


def pairs_json(top: DataFrame, key: str, value: str) -> DataFrame:
    """A list of name and value, greatest first, then by name."""
    rows = _all((-F.col(value)).alias("k"), F.col(key).cast("string").alias("name"), F.col(value).alias("value"))
    return _reply(top, F.transform(rows, lambda r: F.struct(r["name"].alias("name"), r["value"].alias("value"))))


def table_json(top: DataFrame, key: str) -> DataFrame:
    """Columns and rows for a table: name, amount, number of orders."""
    rows = _all((-F.col("order_amount")).alias("k"), F.col(key).cast("string").alias("name"), F.col("order_amount").alias("amount"), F.col("order_ct").alias("ct"))
    columns = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(i).alias("id")) for n, i in (("name", "name"), ("amount", "amount"), ("orders", "ct"))))
    body = F.transform(rows, lambda r: F.struct(r["name"].alias("name"), r["amount"].alias("amount"), r["ct"].alias("ct")))
    return _reply(top, F.struct(columns.alias("columns"), body.alias("rows")))


def map_json(regions: DataFrame) -> DataFrame:
    rows = _all(F.col("province_name").alias("name"), F.col("order_amount").alias("value"))
    return _reply(regions, F.struct(rows.alias("mapData")))


def hours_json(hours: DataFrame) -> DataFrame:
    rows = _all("hr", "uv_ct", "pv_ct", "new_uv")
    line = lambda c, n: F.struct(F.lit(n).alias("name"), F.transform(rows, lambda r: r[c]).alias("data"))
    return _reply(hours, F.struct(F.transform(rows, lambda r: r["hr"]).alias("categories"), F.array(line("uv_ct", "uv"), line("pv_ct", "pv"), line("new_uv", "new")).alias("series")))


def visitor_json(pivot: DataFrame) -> DataFrame:
    """A table with a row per measure and a column for new and returning visitors."""
    rows = _all("measure", "new_visitors", "old_visitors")
    columns = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(n).alias("id")) for n in ("measure", "new_visitors", "old_visitors")))
    return _reply(pivot, F.struct(columns.alias("columns"), rows.alias("rows")))


def scalar_json(one: DataFrame, column: str) -> DataFrame:
    return one.select(F.to_json(F.struct(F.lit(0).alias("status"), F.coalesce(column, F.lit(0)).alias("data"))).alias("json"))
