"""From raw text to clean rows: parsing, quarantine, filters, log splitting, change decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StringType, StructType

from streammart import schemas
from streammart.functions.scalars import empty, millis

BAD = "_corrupt"


def parse_json(lines: DataFrame, schema: StructType, column: str = "value") -> DataFrame:
    """Text -> typed columns; text that doesn't parse stays in ``_corrupt``."""
    wide = StructType([*schema.fields, StructField(BAD, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    others = [c for c in lines.columns if c != column]
    return lines.select(*others, F.from_json(column, wide, options).alias("j")).select(*others, "j.*")


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(BAD).isNull()).drop(BAD)


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(BAD).isNotNull())


def etl_filter(changes: DataFrame, least: int = 5) -> DataFrame:
    """Changes with a table name and a data image whose JSON is longer than ``least`` characters."""
    return changes.filter(~empty("table") & F.col("data").isNotNull() & (F.length(F.to_json("data")) > least))


def split_start(log: DataFrame) -> DataFrame:
    return log.filter(F.col("start").isNotNull())


def split_page(log: DataFrame) -> DataFrame:
    return log.filter(F.col("start").isNull())


def split_display(log: DataFrame) -> DataFrame:
    """One row per displayed item with its page, and the event's time and device."""
    shown = split_page(log).select("ts", F.col("common.mid").alias("mid"), F.col("page.page_id").alias("page_id"), F.explode("displays").alias("display"))
    return shown.select("ts", "mid", F.col("display").withField("page_id", F.col("page_id")).alias("d")).select("ts", "mid", "d.*")


def decode_changes(records: DataFrame) -> DataFrame:
    """Change records -> database, table, type, ts, data (the row after; empty for deletes)."""
    op = F.lower("op")
    kind = F.when(op.isin("c", "r", "create", "read"), "insert").when(op.isin("u", "update"), "update").when(op.isin("d", "delete"), "delete").otherwise(op)
    return records.select(
        F.col("source.db").alias("database"),
        F.col("source.table").alias("table"),
        kind.alias("type"),
        F.col("ts_ms").alias("ts"),
        F.coalesce("after", F.create_map().cast("map<string,string>")).alias("data"),
    )


def with_create_ts(rows: DataFrame, column: str = "create_time") -> DataFrame:
    """Adds create_date, create_hour and create_ts (epoch milliseconds) from a time in text."""
    return rows.withColumns(
        {
            "create_date": F.substring_index(column, " ", 1),
            "create_hour": F.substring(F.substring_index(column, " ", -1), 1, 2),
            "create_ts": millis(column),
        }
    )


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key by ``order`` (most recent first)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_state(changes: DataFrame, keys: list[str], *order) -> DataFrame:
    """The current table behind a change stream: the last change per key, deletes dropped."""
    return latest(changes, keys, *order).filter("type != 'delete'")


def log_events(lines: DataFrame) -> DataFrame:
    return good(parse_json(lines, schemas.LOG_EVENT))


def change_events(lines: DataFrame) -> DataFrame:
    return good(parse_json(lines, schemas.CHANGE_EVENT))
