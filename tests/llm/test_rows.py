"""What every operator takes without crashing: ill-formed UTF-8."""

import hashlib

import corpus_pipeline as P
from pyspark.sql import functions as F
from streammart.llm import bpe, chat, compression, jaccard, langid, mixing, pii, secrets, suffix

BAD = b"a\xffb \xc3 " + b"word \xe2\x82 " * 30 + b"\xf0\x9f token=abcdefghij x@y.zz"


def ill(spark):
    rows = spark.createDataFrame([(1, bytearray(BAD)), (2, bytearray(BAD)), (3, bytearray(b"plain words of english text")), (4, None)], "doc_id long, raw binary")
    return rows.select(
        "doc_id", F.col("raw").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars")
    )


def test_ill_formed_text(spark):
    df = ill(spark)
    turns = df.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), "text")
    assert chat.digests(chat.prefix_target_examples(turns)).count() == 4
    got = {r["doc_id"]: r for r in langid.identify(df, langid.trained(df)).collect()}
    assert got[1]["lang_pred"] == "en" and got[4]["lang_pred"] == "und"
    got = {r["doc_id"]: r for r in compression.rules(df).collect()}
    assert got[1]["n_words"] == len(BAD.split())
    got = {r["doc_id"]: r for r in jaccard.joined(df).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 3, 4]
    got = {r["doc_id"]: r for r in suffix.deduplicated(df).collect()}
    assert bytes(got[1]["kept"]) == BAD and got[2]["n_removed"] == len(BAD)
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert got[1]["size"] == len(BAD.split())
    got = {r["doc_id"]: r for r in bpe.digests(df).collect()}
    ids = bpe.tokenizer().encode(BAD.decode(errors="replace"), add_special_tokens=False).ids
    assert got[1]["n_tokens"] == len(ids) and got[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert {r["doc_id"]: len(r["base"]) for r in secrets.findings(df, secrets.scan(df)).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert {r["doc_id"]: len(r["base"]) for r in pii.extract(df).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_ill_formed_text_in_the_pipeline(spark):
    docs = ill(spark)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() >= 0
