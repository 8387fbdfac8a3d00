"""Shared helpers: input tables, scratch tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of whole texts that go to a Python worker at once; Spark's default of 10,000 holds tens of MB
#: on either side of the pipe for every running task.
BATCH_ROWS = 1000
#: Bytes that go at once: rows may hold a megabyte each (long texts, blocks of positions). One row at least goes.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits, in rows and in bytes, if they are the defaults."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size) == "67108864b":
        spark.conf.set(size, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset on one machine (tests), a temporary one.

    On a cluster each executor would write to a disk of its own, so there the setting must be made.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="streammart-")
        sc.setCheckpointDir(root)
    return root


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    The table outlives lost executors, and its readers get exact statistics.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/streammart-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replayable(docs: DataFrame) -> DataFrame:
    """``docs`` if it is read from files as it is, in the same order each time; else a written copy of it."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.lstrip(" :+-").split("(")[0].split(" ")[0] for line in plan.splitlines() if line.strip()]
    if nodes and nodes[-1].startswith("Relation") and all(n in ("Project", "Filter") for n in nodes[:-1]):
        return docs
    return staged(docs.select("doc_id", "text"), "docs")


#: Keys up to this number are broadcast (some tens of bytes each); more are joined by shuffle.
BROADCAST_KEYS = 1 << 19
#: Parts that the rows of one key are dealt into where a join is by shuffle.
SALTS = 16


def spread(rows: DataFrame, side: DataFrame, keys: list[str], salt: list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """``rows`` joined with ``side`` (unique by ``keys``), however many rows share a key.

    A small side is broadcast after a count; a larger one is repeated under SALTS salts, among which the
    rows of one key are dealt by a hash of their ``salt`` columns.
    """
    if side.count() <= (BROADCAST_KEYS if most is None else most):
        return rows.join(F.broadcast(side), keys, how)
    dealt = rows.withColumn("salt_", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt_")
    return dealt.join(side.select("*", salts), [*keys, "salt_"], how).drop("salt_")


def local(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A small table of the driver's. A list would go through Python workers of another kind, which then wait beside the others."""
    return spark.createDataFrame(pa.table(columns))


def hand_back(spark: SparkSession) -> None:
    """Has the executors collect their garbage, after which a JVM returns the heap that it has no use for.

    A heap that has grown in one step is else kept while the Python workers of the next need memory. One task
    goes to each executor if all are free; those that get none, or ignore such calls, keep what they have.
    """
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, executors, 1, executors).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def drop_staged(df: DataFrame) -> None:
    """Removes the files of a table made by ``staged`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/streammart-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` reduced to ``columns``; absent ones are null strings."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
