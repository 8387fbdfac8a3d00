"""Streaming jobs put together: time-bounded joins, window statistics, routing to sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from streammart import schemas
from streammart.functions.scalars import millis
from streammart.operators import ingest, routing, stats, wide
from streammart.operators.keywords import searched, tokenized
from streammart.sources import readers, writers

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory, and what ``transformWithState`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def timed(rows: DataFrame, column: str, delay: str = "0 seconds") -> DataFrame:
    """Adds ts from a time in text, with a watermark."""
    return rows.withColumn("ts", F.timestamp_millis(millis(column))).withWatermark("ts", delay)


def order_wide(orders: DataFrame, details: DataFrame, bound: str = "5 SECONDS") -> DataFrame:
    """Orders with the details whose time lies within ``bound`` of theirs; both sides need watermarks."""
    left = orders.withColumnRenamed("ts", "order_ts")
    right = details.withColumnRenamed("ts", "detail_ts").withColumnRenamed("id", "detail_id")
    return wide.interval_join(left, right, left["id"] == right["order_id"], left["order_ts"], right["detail_ts"], f"-{bound}", bound)


def payment_wide(payments: DataFrame, orders: DataFrame, look_back: str = "1800 SECONDS") -> DataFrame:
    """Payments with the order rows of up to ``look_back`` before them."""
    left = payments.withColumnRenamed("ts", "callback_ts").withColumnRenamed("id", "payment_id")
    right = orders.withColumnRenamed("ts", "order_ts")
    joined = wide.interval_join(left, right, left["order_id"] == right["id"], left["callback_ts"], right["order_ts"], f"-{look_back}", "0 SECONDS")
    return joined.drop(right["id"])


def visitor_stats(pages: DataFrame, unique: DataFrame, bounced: DataFrame, size: str = "10 seconds", delay: str = "13 seconds") -> DataFrame:
    """Window statistics of the three streams. A bounce is known only after its time limit, so the
    watermark's delay is the usual lateness plus that limit; with less, bounces would be dropped."""
    return stats.visitor_stats(stats.visitor_rows(pages, unique, bounced).withWatermark("ts", delay), size)


def keyword_stats(pages: DataFrame, size: str = "10 seconds") -> DataFrame:
    return stats.keyword_stats(tokenized(searched(pages)), size)


def append(rows: DataFrame, sink, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Runs all that is there through ``sink`` (a foreachBatch function), then stops."""
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.queryName(name) if name else writer
    return writer.foreachBatch(sink).start()


def split_log(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Raw log lines to three folders of JSON lines: start, page, display; bad lines to a fourth."""
    parsed = ingest.parse_json(readers.landing(spark, source), schemas.LOG_EVENT)

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        fine = ingest.good(batch)
        for name, rows in (("start", ingest.split_start(fine)), ("page", ingest.split_page(fine)), ("display", ingest.split_display(fine))):
            writers.as_json(rows).write.mode("overwrite").text(f"{target}/{name}/epoch={epoch}")
        ingest.quarantined(batch).select(F.col(ingest.BAD).alias("value")).write.mode("overwrite").text(f"{target}/bad/epoch={epoch}")
        batch.unpersist()

    return append(parsed, write, checkpoint)


def route_changes(spark: SparkSession, source: str, config: DataFrame, facts: str, dimensions: str, checkpoint: str) -> StreamingQuery:
    """Change events to a folder per fact table and to upserted dimension tables."""
    events = ingest.etl_filter(readers.typed(readers.landing(spark, source), schemas.CHANGE_EVENT))
    upsert = writers.dimension_sink(dimensions)

    def write(batch: DataFrame, epoch: int) -> None:
        routed = routing.route(batch, config).persist()
        out = routing.fact_rows(routed).select(F.to_json("data").alias("value"), "sink_table")
        out.write.mode("overwrite").partitionBy("sink_table").text(f"{facts}/epoch={epoch}")
        upsert(routing.dimension_rows(routed), epoch)
        routed.unpersist()

    return append(events, write, checkpoint)
