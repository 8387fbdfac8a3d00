"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its content (SHA-256). Only blobs that the ledger hasn't yet
seen under the current rule version are scanned, each once however many paths hold it; findings go
back to all paths by blob. The ledger lasts: a Parquet table of (rule_version, blob) with the places of
findings, to which every run that names it appends what it scanned and which the next run reads, whatever
table it scans; a change of rules is a new rule version, and all is scanned anew.

Rules: the three base kinds, and two more: ``pem`` (a private-key header) and ``jwt`` (a signed token).

Defined results: a null text is empty and has no finding; rows with equal doc_id are separate versions
and rows of their own; null doc_id too; an empty table gives no rows; other columns are ignored; a
blob held by any number of documents is scanned once; ill-formed UTF-8 is read as Java reads it; very
long texts count whole, in time that grows with their length.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streammart.llm import spans as S
from streammart.llm.common import BROADCAST_KEYS, scratch_root, spread, staged, table

NAME = "op9_secret_ledger"

# The patterns of the base kinds.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[a-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# The method's own kinds.
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"

#: The rules in force, by a digest of all patterns.
RULE_VERSION = hashlib.sha256("\n".join((ASSIGN, ASSIGN_HEAD, ACCESS, HEX, PEM, JWT)).encode()).hexdigest()[:16]
SPAN = "struct<start:int,rank:int,end:int,kind:string>"
LEDGER = f"blob binary, base array<{SPAN}>, more array<{SPAN}>"
#: Blobs with findings up to this number (some hundred bytes each) are broadcast; more are joined by shuffle.
BROADCAST_HITS = 1 << 17


def base_spans(text: Column) -> Column:
    low = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | F.contains(low, F.lit(word))
    always = lambda m: F.length(m) > 0
    return F.concat(
        S.found(text, "assign", 0, ASSIGN, named, lambda m: F.length(F.regexp_replace(m, ASSIGN_HEAD, "")) >= 8),
        S.found(text, "access", 1, ACCESS, F.contains(text, F.lit("AKIA")), always),
        S.found(text, "hex", 2, HEX, text.rlike(HEX), always),
    )


def more_spans(text: Column) -> Column:
    always = lambda m: F.length(m) > 0
    return F.concat(
        S.found(text, "pem", 3, PEM, F.contains(text, F.lit("PRIVATE KEY")), always),
        S.found(text, "jwt", 4, JWT, F.contains(text, F.lit("eyJ")), always),
    )


def blob_of(text: Column) -> Column:
    """The address of a version: the SHA-256 of its content, a null text being empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> path, blob: the address of every version."""
    return docs.select(F.col("doc_id").alias("path"), blob_of(F.col("text")).alias("blob"))


def ledger_path(spark: SparkSession) -> str:
    """The lasting ledger that the setting ``streammart.secrets.ledger`` names; without it, one of this run's own.

    So a run that names no ledger scans every blob of its table, whatever ran before it.
    """
    return spark.conf.get("streammart.secrets.ledger", None) or f"{scratch_root(spark)}/streammart-ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, path: str, rule_version: str = RULE_VERSION) -> DataFrame | None:
    """blob, base, more of every blob scanned under the rules, one row each; None before the first scan."""
    part = f"{path}/rule_version={rule_version}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(LEDGER).parquet(part).dropDuplicates(["blob"])  # two scans at a time may write one blob


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob, base, more) of the blobs in ``docs`` that ``ledger`` lacks, each scanned once.

    Copies meet in the aggregate, within tasks first, so a blob that a third of all paths hold is no hot key.
    """
    texts = docs.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:  # addresses first: only texts of unseen blobs move
        unseen = staged(versions(docs).select("blob").distinct().join(ledger.select("blob"), "blob", "left_anti"), "unseen")
        few = unseen.count() <= BROADCAST_KEYS
        texts = texts.join(F.broadcast(unseen) if few else unseen, "blob", "left_semi")
    # The largest of equal texts is any of them; unlike first(), it is the same on every run.
    once = texts.groupBy("blob").agg(F.max("text").alias("text"))
    return once.select("blob", _bare(S.in_order(base_spans(F.col("text")))).alias("base"), _bare(S.in_order(more_spans(F.col("text")))).alias("more"))


def _bare(spans: Column) -> Column:
    """Places and kinds alone: the ledger holds no secret."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))


def record(docs: DataFrame, path: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans what the lasting ledger at ``path`` lacks, appends it, and gives the ledger back."""
    spark = docs.sparkSession
    path = path or ledger_path(spark)
    new = scan(docs, read_ledger(spark, path, rule_version))
    new.write.mode("append").parquet(f"{path}/rule_version={rule_version}")
    return read_ledger(spark, path, rule_version)


def hits_of(ledger: DataFrame) -> DataFrame:
    return ledger.filter((F.size("base") > 0) | (F.size("more") > 0)).select("blob", "base", "more")


def _with_hits(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """``rows`` with a ``blob`` beside base and more of it, null where it has no finding."""
    addresses = rows.select("blob").distinct()
    hits = staged(hits_of(ledger).join(addresses, "blob", "left_semi"), "hits")
    return spread(rows.withColumn("rid_", F.monotonically_increasing_id()), hits, ["blob"], ["rid_"], "left", most=BROADCAST_HITS).drop("rid_")


def findings(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every version's path with its blob's findings: doc_id, base, more (arrays of spans)."""
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    return _with_hits(versions(docs), ledger).select(
        F.col("path").alias("doc_id"),
        F.coalesce("base", empty).alias("base"),
        F.coalesce("more", empty).alias("more"),
    )


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET]`` and n_chars set anew; same columns."""
    ledger = record(docs, path)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), blob_of(F.col("text")).alias("blob"))
    joined = _with_hits(row, ledger)
    hit = F.col("base").isNotNull()
    text = F.when(hit & F.col("row.text").isNotNull(), S.redacted(F.col("row.text"), F.concat("base", "more"), "[SECRET]")).otherwise(F.col("row.text"))
    out = {c: F.col("row")[c] for c in docs.columns} | {"text": text}
    changed = joined.select(*(v.alias(c) for c, v in out.items()), hit.alias("hit_"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("hit_"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = findings(docs, record(docs))
    return rows.select(
        "doc_id",
        S.counted(F.col("base"), "assign").alias("n_assign"),
        S.counted(F.col("base"), "access").alias("n_access"),
        S.counted(F.col("base"), "hex").alias("n_hex"),
        F.sha2(S.listed_in_order(F.col("base")), 256).alias("base_sha256"),
        S.listed_in_order(F.concat("base", "more")).alias("spans"),
    )


def _sql_kind(kind: str, rank: int, pattern: str, keep: str) -> str:
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, s AS a, s + length(m) AS b FROM (
    SELECT rid, m, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m) AS s FROM (
      SELECT rid, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (
        SELECT rid, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gs FROM t)))
  WHERE {keep}"""


def _quoted(p: str) -> str:
    return p.replace("'", "''")


SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS (
  {_sql_kind("assign", 0, _quoted(ASSIGN), f"length(regexp_replace(m, '{_quoted(ASSIGN_HEAD)}', '')) >= 8")}
  UNION ALL {_sql_kind("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 16")}
  UNION ALL {_sql_kind("hex", 2, HEX, "true")}
  UNION ALL {_sql_kind("pem", 3, PEM, "true")}
  UNION ALL {_sql_kind("jwt", 4, JWT, "true")}
)
SELECT doc_id, count(f.rid) FILTER (WHERE rank = 0) AS n_assign, count(f.rid) FILTER (WHERE rank = 1) AS n_access,
  count(f.rid) FILTER (WHERE rank = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank), '') AS spans
FROM t LEFT JOIN f USING (rid) GROUP BY rid, doc_id
"""
