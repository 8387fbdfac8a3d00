"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``RATE`` of all
words; a target stops at ``MOST`` times its source's size and the excess goes to the others by weight
(water filling: one level for all sources below their cap).

Taking: complete epochs first (target over source size, whole part). The rest of the target is a
fractional epoch: every document draws an exponential key scaled by its quality weight, keys are
sorted within the source, and the prefix whose sizes come nearest the remaining budget is taken.
Keys come from a digest of doc_id, so reruns agree. Quality: labelled good 2, bad 0.5, otherwise 1.

The prefix sums run in two levels, since one source can hold a third of all rows: a document's bucket
is a fixed function of its key, sizes are summed by source and bucket, and only documents of the one
bucket per source that holds the budget's edge are sorted.

Defined results: a null text has size 0; size-0 documents are taken 0 words; a null source is a source
of its own; rows with equal doc_id share a key and are ordered by size, the whole run of equal rows
being taken or not by its own place; null doc_id draws as the empty string; empty tables give no rows;
ill-formed UTF-8 counts as its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streammart.llm.common import staged, table
from streammart.llm.tokens import lean, sliced, texts

NAME = "op7_mix_sources"
WEIGHTS = (5, 2, 1)
RATE, MOST, BUCKETS = 1.5, 2.0, 1024
GOOD, BAD = 2.0, 0.5
#: Tables of so many rows (some tens of bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1 << 19


def word_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of (text, ...) and size, the number of words of the whole text."""

    def count(batches):
        for batch in sliced(batches):
            sizes = [len(t.split()) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(np.array(sizes, np.int64))], [*keep, "size"]
            )

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(lean(count), f"{schema}, size long")


def draw(doc_id: Column, quality: Column) -> Column:
    """The exponential key -ln(u) / quality, u from 48 bits of the MD5 of doc_id."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**48))) / quality


def bucket(key: Column) -> Column:
    """Ascending in the key; even for quality 1."""
    return F.floor((F.lit(1.0) - F.exp(-key)) * BUCKETS).cast("int")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> target, one row per source."""
    # One row per source: these windows order sources, not documents.
    by_name = W.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weighed = sizes.select("*", F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1).alias("weight"))
    # Water filling: the sources with the least cap per weight are full first.
    fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    every = W.partitionBy()
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    level = weighed.select(
        "*",
        (
            (F.lit(RATE) * F.sum("source_size").over(every) - F.lit(MOST) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
            / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("rest"),
    )
    full = F.lit(MOST) * F.col("source_size") <= F.col("rest") * F.col("weight")
    # The level is that of the first source that isn't full; those before it are all full.
    candidate = F.struct(F.col("source_size") / F.col("weight"), F.col("rest").alias("level"))
    first = level.select("*", F.min(F.when(~full, candidate)).over(every).alias("f"))
    return first.select(
        "source",
        "source_size",
        F.round(
            F.when(F.col("f").isNull(), F.lit(MOST) * F.col("source_size")).otherwise(
                F.least(F.lit(MOST) * F.col("source_size"), F.col("f.level") * F.col("weight"))
            ),
            6,
        ).alias("target"),
    )


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, source) -> doc_id, size, source, source_size, target, epochs (times taken), taken."""
    sized = word_counts(docs.select("doc_id", "source", "text"), ["doc_id", "source"])
    quality = F.lit(1.0)
    if labels is not None:
        rated = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
        sized = sized.join(rated, "doc_id", "left")
        quality = F.when(F.col("q") > 0, GOOD).when(F.col("q") == 0, BAD).otherwise(1.0)
    keyed = sized.select("doc_id", "source", "size", draw(F.col("doc_id"), quality).alias("key"))
    drawn = staged(keyed.withColumn("bucket", bucket(F.col("key"))), "drawn")
    sums = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = staged(sums, "sums")
    goals = targets(sums.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")))
    # Whole epochs, and where the rest of the budget ends among the buckets.
    goals = goals.select(
        "*",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = W.partitionBy("source").orderBy("bucket")
    placed = sums.select(
        F.col("source").alias("s"),
        F.col("bucket").alias("b"),
        (F.sum("words").over(upto) - F.col("words")).alias("before"),
        "words",
    )
    buckets = placed.join(goals, same(placed["s"], goals["source"])).select(
        "s", "b", "before", "words", "source_size", "target", "whole", "rest"
    )
    rows = drawn.join(buckets, same(drawn["source"], buckets["s"]) & (drawn["bucket"] == buckets["b"]))
    edge = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    order = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = rows.filter(edge).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    below = F.col("before") + F.col("words") <= F.col("rest")
    sure = rows.filter(~edge).withColumn("ahead", F.when(below, F.lit(-1)).cast("long"))
    # A document at the edge is taken if its middle lies within the budget: off by half of it at most.
    extra = F.when(F.col("ahead") == -1, 1).when(F.col("ahead") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)
    return (
        inside.unionByName(sure)
        .withColumn("epochs", (F.col("whole") + F.when(F.col("rest") > 0, extra).otherwise(0)).cast("long"))
        .select(
            "doc_id",
            "size",
            "source",
            "source_size",
            "target",
            "epochs",
            (F.col("epochs") * F.col("size")).alias("taken"),
        )
    )


def mixed(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as many times as it is taken.

    Rows that share a doc_id and a source are taken the same number of times: the most of any of them.
    """
    taken = (
        mix(docs, labels)
        .filter("epochs > 0")
        .groupBy(F.col("doc_id").alias("taken_id"), F.col("source").alias("taken_source"))
        .agg(F.max("epochs").alias("epochs"))
    )
    taken = staged(taken, "taken")
    few = taken.count() <= BROADCAST_ROWS
    right = F.broadcast(taken) if few else taken
    on = same(F.col("doc_id"), F.col("taken_id")) & same(F.col("source"), F.col("taken_source"))
    copies = F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))).alias("copy")
    return docs.join(right, on).select(*(F.col(f"`{c}`") for c in docs.columns), copies).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


SQL = f"""
WITH q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / {float(2**48)}::DOUBLE)
      / CASE WHEN q > 0 THEN {GOOD} WHEN q = 0 THEN {BAD} ELSE 1.0 END::DOUBLE AS key
  FROM documents LEFT JOIN q USING (doc_id)
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (
  SELECT *, ({RATE}::DOUBLE * sum(source_size) OVER () - {MOST}::DOUBLE * coalesce(sum(source_size) OVER b, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS rest
  FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (SELECT min_by(rest, source_size / weight) AS level FROM l WHERE {MOST} * source_size > rest * weight),
g AS (
  SELECT source, source_size, round(coalesce(least({MOST}::DOUBLE * source_size, level * weight), {MOST}::DOUBLE * source_size), 6) AS target
  FROM l, level
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g
), r AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN rest > 0 AND ahead + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""
