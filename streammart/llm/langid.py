"""Language identification by nearest centroid.

Features: byte n-grams (1 to ``MAX_N``) of the whole text, letters in lower case (ASCII), every other
ASCII run a single space, hashed into ``DIMENSIONS`` counters. A text's vector is its term
frequency times inverse document frequency, normalised. Each language has up to ``CENTROIDS``
centroids from spherical k-means over its training rows; a text belongs to the language of the centroid
with the greatest cosine. Rejection is by distance: a text farther from its centroid than nearly all
training rows of that language are (quantile ``REJECT_QUANTILE`` and a margin that grows for short
texts, whose vectors scatter) is rejected.

Training is bounded by ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` of text over all languages, chosen by a
digest of doc_id and text and never from held-out rows. The model is a few MB whatever the corpus; prediction needs no shuffle.

Defined results: null text or one without a letter gives ``und``, score 0, rejected; so does every row
where no training row exists; null doc_id is not held out; repeated rows are rows of their own; an
empty table gives no rows; other columns are ignored; ill-formed UTF-8 counts as its bytes and is no
letter; very long texts count whole; equal cosines go to the first centroid; lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streammart.llm.common import local, table
from streammart.llm.tokens import lean, release, sliced, texts

NAME = "op2_language_centroids"
SQL = None
MAX_N, DIMENSIONS, CENTROIDS, ROUNDS = 3, 1 << 13, 12, 8
#: Bounds of what the model is fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 64 << 20
REJECT_QUANTILE, MARGIN, SHORT = 0.01, 0.2, 6.0
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
_FOLD = np.array([b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint32)


def counts(text: bytes) -> np.ndarray:
    """Hashed n-gram counts of the whole text, as float32."""
    b = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    out = np.zeros(DIMENSIONS, np.int64)
    code = np.zeros(len(b), np.uint32)
    for n in range(MAX_N):
        if len(b) <= n:
            break
        code = code[: len(b) - n] * np.uint32(257) + b[n:]
        slot = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - 13)
        out += np.bincount(slot.astype(np.int32), minlength=DIMENSIONS)
    return out.astype(np.float32)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighs and normalises counts in place: the sample's matrix exists once."""
    found *= idf
    found /= np.maximum(np.sqrt(np.einsum("ij,ij->i", found, found))[:, None], 1e-9)
    return found


def clustered(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from rows far from one another. Rows are never copied."""
    centers = [v.mean(axis=0)]
    for _ in range(k):
        centers.append(v[np.argmin(np.max(v @ np.array(centers).T, axis=1))])
    c = np.array(centers[1:])
    for _ in range(ROUNDS):
        own = np.argmax(v @ c.T, axis=1)
        sums = (own == np.arange(len(c))[:, None]).astype(np.float32) @ v
        c = np.where(np.bincount(own, minlength=len(c))[:, None] > 0, sums, c)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def has_letter(text: str) -> bool:
    """Whether some character is a letter (Unicode category L)."""
    return any(map(str.isalpha, text))


def leeway(n_bytes: np.ndarray) -> np.ndarray:
    """How far a text's cosine may lie lower for being short."""
    return SHORT / np.sqrt(n_bytes + 100.0)


def fit(rows: list[tuple[bytes, str]]) -> dict:
    """Model from (text, lang) rows: langs, centroids (language of each), idf, and the least cosines."""
    rows = sorted((r for r in rows if r[0] and r[1] is not None and has_letter(r[0].decode(errors="replace"))), key=lambda r: (r[1], r[0]))
    if not rows:
        return {"langs": []}
    v = np.empty((len(rows), DIMENSIONS), np.float32)
    for j, (t, _) in enumerate(rows):
        v[j] = counts(t)
    idf = (np.log((1 + len(rows)) / (1 + np.count_nonzero(v, axis=0))) + 0.1).astype(np.float32)
    vectors(v, idf)
    langs = sorted({lang for _, lang in rows})
    size = np.array([len(t) for t, _ in rows], float)
    ends = np.searchsorted([lang for _, lang in rows], langs, "right").tolist()
    centers, owner, least = [], [], []
    for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):  # one language's rows: a view
        c = clustered(v[a:b], min(CENTROIDS, b - a))
        centers.append(c)
        owner += [i] * len(c)
        near = (v[a:b] @ c.T).max(axis=1) + leeway(size[a:b])
        least.append(np.quantile(near, REJECT_QUANTILE) - MARGIN)
    return {
        "langs": langs,
        "centers": np.concatenate(centers).astype(np.float32),
        "owner": np.array(owner),
        "idf": idf,
        "least": np.array(least),
    }


def predicted(model: dict, found: list[bytes]) -> list[tuple[str, float, bool]]:
    """(language, score, rejected) of each text."""
    if not model["langs"]:
        return [("und", 0.0, True)] * len(found)
    out: list[tuple[str, float, bool]] = []
    for at in range(0, len(found), 256):
        raw = found[at : at + 256]
        near = vectors(np.array([counts(t) for t in raw]), model["idf"]) @ model["centers"].T
        best = np.argmax(near, axis=1)
        score = near[np.arange(len(raw)), best]
        lang = model["owner"][best]
        size = np.array([len(t) for t in raw], float)
        far = score + leeway(size) < model["least"][lang]
        for j, t in enumerate(raw):
            if has_letter(t.decode(errors="replace")):
                out.append((model["langs"][lang[j]], float(min(1.0, max(0.0, score[j]))), bool(far[j])))
            else:
                out.append(("und", 0.0, True))
    return out


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Fits the model on at most ``rows`` labelled rows and ``SAMPLE_BYTES`` of text, alike of each language.

    A row's place in the draw is a digest of its doc_id and text, so the sample is the same however the
    table is split. Every language has a row at least; of more languages than ``rows``, the most frequent.
    """
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("text").cast("binary").alias("text"), "lang", F.col("doc_id").cast("string").alias("id")
    )
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 32)).cast("double") / float(1 << 32)
    per = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("least")).orderBy(F.desc("n"), "lang").limit(rows)
    sizes = per.collect()
    if not sizes:
        return fit([])
    each = max(1, rows // len(sizes))
    # A first cut by a hash of doc_id leaves about twice the wanted rows of each language, one at least;
    # the order of digests decides among them.
    cuts = [(r["lang"], max(r["least"], min(1.0, (2 * each + 50) / r["n"]))) for r in sizes]
    cuts = local(docs.sparkSession, lang=pa.array([c[0] for c in cuts], pa.string()), upto=pa.array([c[1] for c in cuts], pa.float64()))
    near = usable.join(F.broadcast(cuts), "lang").filter(draw <= F.col("upto")).withColumn("key", F.md5(F.concat_ws("|", "id", F.md5("text"))))
    order = W.partitionBy("lang").orderBy("key", "text")
    chosen = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).orderBy("n", "lang").select("text", "lang")
    found, held = [], 0
    for r in chosen.toLocalIterator():
        found.append((bytes(r["text"]), r["lang"]))
        held += len(found[-1][0])
        if held > SAMPLE_BYTES:
            break
    model = fit(found)
    release()
    return model


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in sliced(batches):
            found = predicted(known, list(texts(batch)))
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score", "rejected"]
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")
    ).mapInArrow(lean(run), SCHEMA)


def labelled(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred, score and rejected beside its own columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in sliced(batches):
            found = predicted(known, list(texts(batch)))
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, "lang_pred", "score", "rejected"])

    kept = docs.select(*(F.col(f"`{c}`") for c in names))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(lean(run), f"{fields}, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, trained(docs))
