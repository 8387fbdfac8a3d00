"""A training corpus from ``documents``: language, near duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. ``run`` applies them one after another, with each stage's result as a table in the
cluster's shared folder, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streammart.llm import bpe, jaccard, langid, mixing, secrets
from streammart.llm.common import hand_back, staged, table, with_missing

#: Near duplicates: shingles of so many words, similarity of so many percent or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Bytes of words of a block of the token stage: half of the operator's, as other stages have filled the executors.
TOKEN_BLOCK = 4 << 20
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def opened(docs: DataFrame) -> DataFrame:
    """A stage's input; first the executors hand back what the stage before has left in their heaps."""
    hand_back(docs.sparkSession)
    return with_missing(docs, COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-centroid classifier rejects go; lang becomes the predicted one."""
    docs = opened(docs)
    return langid.labelled(docs, langid.trained(docs)).filter(~F.col("rejected")).select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars"
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones stays: the smallest doc_id (null last), of equal ids one text.

    Rows are told apart by doc_id and text, so unrelated rows of one doc_id are judged apart; of repeated
    rows one stays. Rows without a word are in no group and stay.
    """
    key = ["doc_id", "row_key"]
    docs = opened(docs).withColumn("row_key", F.xxhash64("text"))
    groups = jaccard.joined(docs, NEAR_WORDS, NEAR_PERCENT, ("row_key",)).filter("n_shingles > 0")
    rows = staged(groups.groupBy(*key).agg(F.first("root").alias("root"), F.count("*").alias("n")), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), *key)
    first = rows.groupBy("root").agg(F.min(place).alias("first"))
    marked = rows.join(first, "root").select(*key, "n", (place == F.col("first")).alias("stays"))
    marked = staged(marked.filter("not stays or n > 1"), "marked")

    def among(some: DataFrame, kind: str, those: DataFrame) -> DataFrame:
        side = those.select(*(F.col(c).alias(f"{c}_") for c in key))
        side = F.broadcast(side) if those.count() <= jaccard.BROADCAST_KEYS else side
        return some.join(side, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & F.col("row_key").eqNullSafe(F.col("row_key_")), kind)

    kept = among(docs, "left_anti", marked.filter("not stays"))
    twice = marked.filter("stays")
    if not twice.isEmpty():
        kept = among(kept, "left_anti", twice).unionByName(among(kept, "left_semi", twice).dropDuplicates(key))
    return kept.select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret that the blob ledger's scan finds is replaced by a mark; no document goes."""
    return secrets.redact(opened(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as many times as the mixture takes it; those it doesn't take go."""
    docs = opened(docs)
    return mixing.mixed(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row of the mixture."""
    return bpe.digests(opened(docs), most=TOKEN_BLOCK)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("bpe_tokens", tokenize),
]

#: Neither the trained classifier nor the tokenizer has a SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
