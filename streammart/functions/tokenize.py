"""Tokenizer: lower-case letter and digit runs; runs of CJK characters as overlapping pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

RUN = r"[\p{L}\p{N}]+"
CJK = r"[\p{IsHan}]"


def words(text: Column) -> Column:
    """Array of tokens in order."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0))
    pairs = lambda r: F.when(
        F.length(r) > 2, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    ).otherwise(F.array(r))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^{CJK}+$"), pairs(r)).otherwise(F.array(r))))


def register(spark: SparkSession, name: str = "ik_analyze", segment: Callable[[str], Iterable[str]] | None = None) -> None:
    """Registers the tokenizing table function for SQL's LATERAL; a dictionary segmenter can replace the rule."""
    import re

    from pyspark.sql.functions import udtf

    # A table function over Python is for pluggable segmenters; ``words`` stays in the JVM.
    cut = segment or (lambda s: re.findall(r"[^\W_]+", s.lower()))

    class Analyze:
        def eval(self, text: str):
            for word in cut(text or ""):
                yield (word,)

    spark.udtf.register(name, udtf(Analyze, returnType="word string"))
