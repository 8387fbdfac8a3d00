"""Sinks: files by topic or day, upserted dimensions, and their streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from streammart.functions.scalars import day_number
from streammart.operators import tables


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    """Each row as JSON text in ``value``; null fields are left out."""
    return rows.select(F.to_json(F.struct(*(columns or ("*",)))).alias("value"))


def to_topic(rows: DataFrame, servers: str, checkpoint: str, topic: str | None = None) -> DataStreamWriter:
    """Stream to a broker: one topic, or each row's own in a column ``topic`` (connector jar needed)."""
    writer = rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint)
    return writer.option("topic", topic) if topic else writer


def by_sink_table(routed: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Routed facts as JSON lines of their data alone, a folder per sink_table; exactly once."""
    rows = routed.select(F.to_json("data").alias("value"), "sink_table")
    return rows.writeStream.format("text").partitionBy("sink_table").option("path", path).option("checkpointLocation", checkpoint)


def partitioned(rows: DataFrame, path: str, keys: list[str], time: str = "stt", drop: tuple[str, ...] = (), mode: str = "append") -> None:
    """Parquet by day (``dt``), sorted by ``keys`` within files, without the columns in ``drop``."""
    out = rows.drop(*drop).withColumn("dt", day_number(time))
    out.repartition("dt").sortWithinPartitions("dt", *keys).write.mode(mode).partitionBy("dt").parquet(path)


def stats_sink(path: str, keys: list[str], drop: tuple[str, ...] = ()):
    """For ``foreachBatch``: appends a micro-batch by day. A repeated batch replaces its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        partitioned(batch, f"{path}/epoch={epoch}", keys, drop=drop, mode="overwrite")

    return write


def _places(spark, path: str):
    """A table's file system, its folder, and the folder that holds its last state while it is replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    before = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}-before")
    return place.getFileSystem(conf), place, before


def restore(spark, path: str) -> None:
    """After a writer that died in ``replace_folder``: the last state comes back if no table stands."""
    fs, place, before = _places(spark, path)
    if fs.exists(before):
        if fs.exists(place):
            fs.delete(before, True)
        elif not fs.rename(before, place):
            raise OSError(f"can't restore {path}")


def replace_folder(spark, source: str, path: str) -> None:
    """Moves ``source`` to ``path``. Until that is done the table's last state is kept beside it, for ``restore``.

    One writer per table; where renames aren't atomic (object stores) the table needs a catalog instead.
    """
    restore(spark, path)
    fs, place, before = _places(spark, path)
    if fs.exists(place) and not fs.rename(place, before):
        raise OSError(f"can't set {path} aside")
    if not fs.rename(_places(spark, source)[1], place):
        restore(spark, path)
        raise OSError(f"can't move {source} to {path}")
    fs.delete(before, True)


def read_if_there(spark, path: str) -> DataFrame | None:
    restore(spark, path)
    fs, place, _ = _places(spark, path)
    return spark.read.parquet(path) if fs.exists(place) else None


def dimension_sink(root: str, keep_deletes: bool = False):
    """For ``foreachBatch``: upserts routed dimension rows into a Parquet table per sink_table.

    All columns are strings, and the last change per key wins. A table is created by its first rows
    and replaced whole, so that a batch that is repeated gives the same table, also after a writer
    that died halfway.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        rules = batch.select("sink_table", "sink_columns", "sink_pk").distinct().collect()  # a row per routing rule
        for table, columns, key in {(r["sink_table"], r["sink_columns"], r["sink_pk"] or "id") for r in rules}:
            path = f"{root}/{table}"
            names = columns.split(",") if columns else None
            rows = batch.filter(F.col("sink_table") == table)
            if names is None:
                names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("data"))).distinct().collect())
            changed = rows.select(*(F.col("data")[c].alias(c) for c in names), "type", F.col("ts").alias("_ts"))
            old = read_if_there(spark, path)
            order = F.desc("_ts")
            new = tables.upsert(old, changed, key, order, keep_deletes=keep_deletes).select(*names)
            aside = f"{root}/.{table}-{uuid.uuid4().hex}"
            new.write.parquet(aside)
            replace_folder(spark, aside, path)
        batch.unpersist()

    return write


def truncate(spark, path: str) -> None:
    """Keeps a table's columns and none of its rows."""
    restore(spark, path)
    empty = spark.read.parquet(path).limit(0)
    aside = f"{path}-{uuid.uuid4().hex}"
    empty.write.parquet(aside)
    replace_folder(spark, aside, path)


def console(rows: DataFrame, checkpoint: str) -> DataStreamWriter:
    return rows.writeStream.format("console").option("checkpointLocation", checkpoint)


def daily_log(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Raw lines appended to a folder per day of arrival."""
    dated = rows.select("value", F.date_format(F.current_timestamp(), "yyyyMMdd").alias("dt"))
    return dated.writeStream.format("text").partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint)
