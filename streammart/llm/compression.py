"""Quality rules: base rules on words and lines, then zstandard compression bands.

A document that passes the base rules is compressed as a whole and in fixed chunks (for others ``ratio``
and ``n_bad_chunks`` are null). Its ratio (bytes
in, over bytes out) must lie within the band of its length class: above it the text is repetitive,
below it incompressible. The whole text catches copies far apart; chunks, the short last one too, catch
a bad part of a text: more than ``MAX_BAD_CHUNKS`` of them outside the band of their length reject it.

Defined results: null text has no words and fails the base rules; repeated rows and equal or null
doc_ids are rows of their own; an empty table gives no rows; other columns are ignored; whole texts
count, however long (memory holds one text and its words at a time); ill-formed UTF-8 counts as its
bytes, where every byte but continuation bytes is a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from streammart.llm.common import table
from streammart.llm.tokens import lean, sliced, texts

NAME = "op3_compression_bands"
SQL = None
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
LEVEL, CHUNK_BYTES, MAX_BAD_CHUNKS = 3, 4096, 0.25
#: Up to so many bytes: least and greatest whole-text ratio. Longer texts of one language compress
#: better, since more of their words have come before; a header's cost weighs on short ones.
BANDS = ((256, 0.95, 3.0), (1024, 1.15, 4.5), (4096, 1.3, 6.0), (16384, 1.4, 8.0), (float("inf"), 1.4, 10.0))
#: The same for chunks. The least ratio lies above what base64 of that many bytes reaches; up to 128
#: bytes a header's cost hides the difference.
CHUNK_BANDS = ((64, 0.0, 3.5), (128, 0.8, 3.5), (256, 1.07, 5.0), (512, 1.2, 6.0), (1024, 1.28, 6.0), (2048, 1.32, 8.0), (4096, 1.35, 8.0))
SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
    base_failed boolean, kept boolean, ratio double, n_bad_chunks long"""
TYPES = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.int64()]
_SYMBOLS = bytes(range(256)).translate(None, b"#*$%&|<>")
_SPACE = b" \t\n\r\x0b\x0c"
_NOT_START = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words covered by WINDOW-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    # Exact: pairs are numbered by rank, three times over, so equal numbers mean equal windows.
    span = 1
    while span < WINDOW:
        pairs = codes[:-span] * (int(codes.max()) + 1) + codes[span:]
        codes = np.unique(pairs, return_inverse=True)[1]
        span *= 2
    twice = np.bincount(codes)[codes] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(text.translate(None, _SPACE + _NOT_START))
    symbols = len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def limits(n: int, bands: tuple) -> tuple[float, float]:
    """Least and greatest ratio of ``n`` bytes."""
    return next((low, high) for most, low, high in bands if n <= most)


def band_verdict(text: bytes, zstd: zstandard.ZstdCompressor) -> tuple[bool, float, int]:
    """Whether the text lies within the bands; its whole ratio; chunks outside their bands."""
    ratio = len(text) / max(1, len(zstd.compress(text)))
    low, high = limits(len(text), BANDS)
    bad = chunks = 0
    for at in range(0, len(text), CHUNK_BYTES):
        chunk = text[at : at + CHUNK_BYTES]
        least, most = limits(len(chunk), CHUNK_BANDS)
        chunks += 1
        bad += not least <= len(chunk) / len(zstd.compress(chunk)) <= most
    return low <= ratio <= high and bad <= MAX_BAD_CHUNKS * chunks, ratio, bad


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    for batch in sliced(batches):
        out: list[tuple] = []
        for text in texts(batch):
            found = base(text)
            failed = found[0] < MIN_WORDS or 100 * found[4] > MAX_REPEAT_PERCENT * found[0]
            within, ratio, bad = (False, None, None) if failed else band_verdict(text, zstd)
            out.append((*found, failed, within and not failed, ratio, bad))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns],
            ["doc_id", *(f.split()[0] for f in SCHEMA.split(",")[1:])],
        )


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the base figures, base_failed, kept and the method's own figures."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(lean(judged), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"))
