"""Sources. Brokers and stores that need connector jars keep their options here; files stand in for them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streammart import schemas
from streammart.functions.scalars import rowtime_from_millis, rowtime_from_text
from streammart.operators.ingest import decode_changes, good, parse_json


def topic(spark: SparkSession, servers: str, name: str, group: str, offsets: str = "latest") -> DataFrame:
    """A stream of text from a broker topic (its connector must be on the classpath)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", name)
        .option("kafka.group.id", group)
        .option("startingOffsets", offsets)
        .load()
    )
    return raw.select(F.col("value").cast("string").alias("value"))


def landing(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of text lines from files that land in a folder: the same rows as ``topic``."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def typed(source: DataFrame, schema: StructType) -> DataFrame:
    """Rows of text that parse; text that doesn't is left out (see ``ingest.quarantined``)."""
    return good(parse_json(source, schema))


def with_rowtime(rows: DataFrame, column: str, delay: str, millis: bool) -> DataFrame:
    """Adds ``rowtime`` from epoch milliseconds or ``yyyy-MM-dd HH:mm:ss`` text, with a watermark."""
    time = rowtime_from_millis(column) if millis else rowtime_from_text(column)
    return rows.withColumn("rowtime", time).withWatermark("rowtime", delay)


def changes(source: DataFrame) -> DataFrame:
    """Change records as connectors write them -> database, table, type, ts, data."""
    return decode_changes(typed(source, schemas.CHANGE_RECORD))


def snapshot_then_changes(snapshot: DataFrame, log: DataFrame, database: str, table: str) -> DataFrame:
    """A table's rows as inserts, united with its later changes."""
    data = F.create_map(*[x for c in snapshot.columns for x in (F.lit(c), F.col(c).cast("string"))])
    first = snapshot.select(
        F.lit(database).alias("database"), F.lit(table).alias("table"), F.lit("insert").alias("type"), F.lit(0).cast("long").alias("ts"), data.alias("data")
    )
    return first.unionByName(log)


def lookup(spark: SparkSession, table: DataFrame, **keys) -> dict | None:
    """The first row whose columns equal the given values, as a dictionary."""
    rows = table
    for name, value in keys.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    found = rows.limit(1).collect()
    return found[0].asDict() if found else None


def records(rows: DataFrame) -> Iterator[dict]:
    """All rows as dictionaries, partition by partition."""
    for row in rows.toLocalIterator():
        yield row.asDict(recursive=True)


def jdbc(spark: SparkSession, url: str, query: str, driver: str, partitions: dict | None = None) -> DataFrame:
    """A query's result over JDBC (the driver's jar must be on the classpath)."""
    options = {"url": url, "query": query, "driver": driver} | (partitions or {})
    return spark.read.format("jdbc").options(**options).load()


def day(spark: SparkSession, path: str, dt: int) -> DataFrame:
    """One day of a table that ``writers.partitioned`` wrote: other days' files aren't read."""
    return spark.read.parquet(path).filter(F.col("dt") == dt)


def resource(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document over several lines."""
    return spark.read.option("multiLine", True).json(path)
