"""Routing of change events by a configuration table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streammart.operators.ingest import latest

#: The configuration has a row per (table, operation); beyond so many rows it is joined by shuffle.
MAX_CONFIG_ROWS = 100_000


def config_latest(changes: DataFrame, *order) -> DataFrame:
    """The rule in force per (source_table, operate_type): the last write; a deleted rule goes."""
    rules = latest(changes, ["source_table", "operate_type"], *order)
    return rules.filter("type != 'delete'") if "type" in rules.columns else rules


def route(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Changes that some rule takes, with sink_type, sink_table, sink_pk and the kept columns of data.

    bootstrap-insert counts as insert. An empty column list keeps all columns; names match exactly.
    """
    kind = F.when(F.col("type") == "bootstrap-insert", "insert").otherwise(F.col("type"))
    events = changes.withColumn("type", kind)
    rules = config.select("source_table", "operate_type", "sink_type", "sink_table", "sink_columns", "sink_pk")
    small = config.limit(MAX_CONFIG_ROWS + 1).count() <= MAX_CONFIG_ROWS if not config.isStreaming else True
    rules = F.broadcast(rules) if small else rules
    routed = events.join(rules, (events["table"] == rules["source_table"]) & (events["type"] == rules["operate_type"]))
    return routed.withColumn("data", project(F.col("data"), F.col("sink_columns")))


def project(data, columns):
    """The entries of a map whose keys a comma list names (no trimming); all if the list is empty."""
    kept = F.map_filter(data, lambda k, v: F.array_contains(F.split(columns, ","), k))
    return F.when(F.coalesce(columns, F.lit("")) == "", data).otherwise(kept)


def dimension_rows(routed: DataFrame) -> DataFrame:
    return routed.filter("sink_type = 'hbase'")


def fact_rows(routed: DataFrame) -> DataFrame:
    return routed.filter("sink_type = 'kafka'")
