"""Connected components of a link table by alternating star contraction; no graph reaches the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streammart.llm.common import drop_staged, staged
from streammart.llm.tokens import lean


#: Links that one task may join by itself (some tens of MB); more are spread and then contracted.
PART = 250_000


def _forest(batches):
    """Within a partition: links become stars (node, least node of its local component)."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 2 * PART:  # what the task holds stays bounded; later rounds join the parts
            stars = [(x, root(x)) for x in parent]
            parent.clear()
            yield _batch(stars)
    yield _batch([(x, root(x)) for x in parent])


def _batch(pairs):
    pairs = [(a, b) for a, b in pairs if a != b]
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["u", "v"]
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step; edges (u, v) with v < u."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root): root is the least node of the component; linked nodes only."""
    parts = 1 + links.count() // PART
    forest = links.select("a", "b").coalesce(parts).mapInArrow(lean(_forest), "u long, v long")
    if parts == 1:  # few enough links for one task: its forest is the answer
        return staged(forest, "edges").select(F.col("u").alias("node"), F.col("v").alias("root"))
    edges = staged(forest.distinct(), "edges")
    before = None
    while True:
        after = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if after == before or after[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
        large = staged(_star(edges, True), "edges")
        small = staged(_star(large, False), "edges")
        for old in (edges, large):
            drop_staged(old)
        edges = small
