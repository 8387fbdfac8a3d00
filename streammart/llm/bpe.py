"""BPE encoding and decoding over a distinct-word table.

The tokenizer never looks across ASCII white space: it drops white space, no pre-token holds any, and
its added tokens strip none. So a text's ids are its words' ids in order.

Spark splits texts into words. Documents are read in blocks of ``BLOCK_BYTES``; a block's distinct words go
to the buckets of a word table, each word to the one bucket of its hash, which encodes it once for the whole
corpus and replies with its ids. A block's replies are joined with its positions (numbers of words in
the block's dictionary), so ids come back by position; what moves is each block's distinct words and
its compressed positions, never texts. Pieces come from a join of the ids that a block uses with the
id-to-piece table, which has one row per vocabulary entry; decoding puts them in the places of the ids.

A block is named by a digest of its dictionary, and its positions are made by a second pass over the
texts, which must see the rows in the same order; tables read from files do, and anything else is
written to the shared folder first. No word is a hot key: a block sends it once.

Defined results: a null text is empty and has no token; repeated rows and equal or null doc_ids are
rows of their own; an empty table gives no rows; other columns are ignored; whole texts count; ill-formed
UTF-8 is read as Java reads it, with U+FFFD in its place.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streammart.llm.common import hand_back, local, planned_bytes, replayable, small_batches, staged, table
from streammart.llm.tokens import lean, release, sliced

NAME = "op8_bpe_word_table"
SQL = None
FILE = "word_bpe_49k.json"
#: Words of about so many bytes make a block, in whole documents.
BLOCK_BYTES = 8 << 20
#: Buckets of the word table: one for so many bytes of input, between these bounds.
BUCKET_BYTES, BUCKETS = 32 << 20, (8, 1 << 16)
#: Words that go to the library at a time.
CALL = 1024
#: Positions that are put together at a time (one document at least).
AT_ONCE = 1 << 15
SPACE = " \t\n\x0b\f\r"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def tokenizer(file: str = FILE):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path(file))
    made.no_padding()
    made.no_truncation()
    return made


def pieces(spark: SparkSession, file: str = FILE) -> DataFrame:
    """id, piece: the vocabulary, one row per entry."""
    vocabulary = sorted(tokenizer(file).get_vocab(with_added_tokens=True).items())
    return local(spark, id=pa.array([n for _, n in vocabulary], pa.int32()), piece=pa.array([p for p, _ in vocabulary], pa.string()))


def split(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, words: the text's words in order."""
    text = F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(SPACE))
    words = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"[\x20\x09-\x0D]+", -1))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))


class Block:
    """Documents in order, the dictionary of their words by bucket, and every position's place in it.

    ``sent`` has each bucket's words, a line each; no word is an object of its own for longer than a call.
    """

    def __init__(self, ids: list, sizes: list, words: list, buckets: int):
        self.ids, self.sizes = pa.concat_arrays(ids), np.concatenate(sizes).astype(np.int64)
        coded = pa.chunked_array(words).unify_dictionaries().chunks
        found, at = coded[0].dictionary.cast(pa.large_binary()), np.concatenate([c.indices.to_numpy() for c in coded])
        codes = (zlib.crc32(w) for i in range(0, len(found), CALL) for w in found.slice(i, CALL).to_pylist())
        bucket = np.fromiter(codes, np.uint32, len(found)) % np.uint32(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int64)
        lines = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts), found.take(pa.array(order))), pa.scalar(b"\n", pa.large_binary()))
        self.buckets = np.flatnonzero(cuts[:-1] < cuts[1:]).tolist()
        self.sent = [lines[b].as_py() for b in self.buckets]
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        self.at = place[at] if len(found) else np.zeros(0, np.uint32)
        self.name = xxhash.xxh3_128_digest(b"\n".join(self.sent))


def blocks(batches: Iterator[pa.RecordBatch], buckets: int, most: int) -> Iterator[Block]:
    """Words are numbered slice by slice, so that a block holds numbers and distinct words, not its texts."""
    ids, sizes, words, held = [], [], [], 0
    for batch in sliced(batches, "words"):
        column = batch.column("words")
        flat = column.flatten()
        ids.append(batch.column("doc_id").take(pa.array(np.arange(batch.num_rows))))  # a copy: the batch goes
        sizes.append(pc.list_value_length(column).to_numpy(zero_copy_only=False))
        words.append(flat.dictionary_encode())
        held += flat.nbytes
        del batch, column, flat
        if held >= most:
            block = Block(ids, sizes, words, buckets)
            ids, sizes, words, held = [], [], [], 0
            yield block
            del block
            release()
    if ids:
        yield Block(ids, sizes, words, buckets)


def requests(texts: DataFrame, buckets: int, most: int | None = None) -> DataFrame:
    """block, bucket, words: each block's distinct words by bucket."""
    most = most or BLOCK_BYTES

    def run(batches):
        zstd = zstandard.ZstdCompressor(level=3)
        for block in blocks(batches, buckets, most):
            name, some, sent = block.name, block.buckets, list(map(zstd.compress, block.sent))
            del block
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.binary()), pa.array(some, pa.int32()), pa.array(sent, pa.binary())], ["block", "bucket", "words"])

    return texts.mapInArrow(lean(run), "block binary, bucket int, words binary")


def replies(asked: DataFrame, file: str = FILE) -> DataFrame:
    """block, bucket, ids (of the words asked for, in order), used (the distinct ids).

    A bucket's table holds every word that any block has asked it for, encoded when first asked for.
    """

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would each hold memory of their own
        made, zip_, unzip = tokenizer(file), zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        known: dict[bytes, bytes] = {}  # 32-bit ids
        at = None
        for batch in batches:
            for block, bucket, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "words")), strict=True):
                if bucket != at:
                    known, at = {}, bucket
                words = unzip.decompress(raw).split(b"\n")
                new = [w for w in words if w not in known]
                for i in range(0, len(new), CALL):
                    some = new[i : i + CALL]
                    for w, e in zip(some, made.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, np.int32).tobytes()
                found = [known[w] for w in words]
                sizes, ids = np.fromiter(map(len, found), np.int32, len(found)) // 4, np.frombuffer(b"".join(found), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.binary()),
                        pa.array([bucket], pa.int32()),
                        pa.array([zip_.compress(_planes(sizes))], pa.binary()),
                        pa.array([zip_.compress(_planes(ids))], pa.binary()),
                        pa.array([np.unique(ids)], pa.list_(pa.int32())),
                    ],
                    ["block", "bucket", "sizes", "ids", "used"],
                )

    rows = asked.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(lean(run), "block binary, bucket int, sizes binary, ids binary, used array<int>")


def _planes(values: np.ndarray) -> bytes:
    """32-bit integers with their bytes apart, which compresses."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _values(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def positions(texts: DataFrame, buckets: int, most: int | None = None) -> DataFrame:
    """block, doc_ids, sizes, at: each block's documents and the places of their words in its dictionary."""
    most = most or BLOCK_BYTES

    def run(batches):
        zstd = zstandard.ZstdCompressor(level=3)
        for block in blocks(batches, buckets, most):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.name], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(block.ids)], pa.int32()), block.ids),
                    pa.array([zstd.compress(block.sizes.tobytes())], pa.binary()),
                    pa.array([zstd.compress(_planes(block.at))], pa.binary()),
                ],
                ["block", "doc_ids", "sizes", "at"],
            )

    return texts.mapInArrow(lean(run), "block binary, doc_ids array<bigint>, sizes binary, at binary")


def _joined(strings: pa.Array, at: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Of each run (places up to its end), its places' strings with a space between."""
    taken = strings.take(pa.array(at))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int64)), taken), pa.scalar(b" ", pa.large_binary()))


def assembled(docs: DataFrame, file: str, result: Callable[[pa.Array, np.ndarray, list[bytes], list[bytes]], pa.RecordBatch], schema: str, most: int | None = None) -> DataFrame:
    """Every document's ids and decoded text, given to ``result`` as (doc_ids, counts, ids as text, decoded).

    Smaller blocks (``most`` bytes of words) hold less memory and send a word more often.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = split(replayable(docs))
    buckets = min(BUCKETS[1], max(BUCKETS[0], planned_bytes(docs) // BUCKET_BYTES))
    found = staged(replies(requests(texts, buckets, most), file), "replies")
    hand_back(spark)
    used = found.select("block", F.explode("used").alias("id")).distinct().join(F.broadcast(pieces(spark, file)), "id")
    null = lambda kind: F.lit(None).cast(kind)
    names = used.groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))
    rows = (
        names.select("block", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), null("binary").alias("sizes"), null("binary").alias("payload"), null("array<bigint>").alias("doc_ids"), "pieces")
        .unionByName(found.select("block", F.lit(1).alias("kind"), "bucket", "sizes", F.col("ids").alias("payload")), allowMissingColumns=True)
        .unionByName(positions(texts, buckets, most).select("block", F.lit(2).alias("kind"), F.lit(0).alias("bucket"), "sizes", F.col("at").alias("payload"), "doc_ids"), allowMissingColumns=True)
    )

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        name, piece, got, ready = None, {}, {}, None
        for batch in batches:
            for i in range(batch.num_rows):
                block, kind = batch.column("block")[i].as_py(), batch.column("kind")[i].as_py()
                if block != name:
                    name, piece, got, ready = block, {}, {}, None
                    release()
                if kind == 0:
                    entry = batch.column("pieces")[i].values
                    piece = dict(zip(entry.field("id").to_pylist(), entry.field("piece").cast(pa.binary()).to_pylist(), strict=True))
                    continue
                sizes, payload = (unzip.decompress(batch.column(c)[i].as_py()) for c in ("sizes", "payload"))
                if kind == 1:  # blocks of equal dictionaries have equal replies: one counts
                    got[batch.column("bucket")[i].as_py()] = (_values(sizes), _values(payload))
                    continue
                at, each = _values(payload), np.frombuffer(sizes, np.int64)
                del payload
                if ready is None:
                    ready = table_of(got, piece)
                    piece, got = {}, {}
                counts, ids, text = ready
                if len(at) and int(at.max()) >= len(counts):
                    raise RuntimeError("a block of documents has no reply: its rows came in another order when read again")
                ends = np.cumsum(each)
                upto = np.zeros(len(at) + 1, np.int64)
                if len(at):
                    np.cumsum(counts[at], out=upto[1:])
                n = upto[ends] - upto[ends - each]
                if len(at) and not counts.all():  # words without an id leave no trace
                    full = counts[at] > 0
                    ends = np.concatenate([[0], np.cumsum(full)])[ends]
                    at = at[full]
                doc_ids, begin = batch.column("doc_ids")[i].values, 0
                while begin < len(ends):  # some documents at a time: strings of all positions are large
                    first = int(ends[begin - 1]) if begin else 0
                    end = max(begin + 1, int(np.searchsorted(ends, first + AT_ONCE)))
                    some, upto = at[first : ends[end - 1]], ends[begin:end] - first
                    yield result(doc_ids.slice(begin, end - begin), n[begin:end], _joined(ids, some, upto).to_pylist(), _joined(text, some, upto).to_pylist())
                    begin = end

    def table_of(got, piece):
        """Of a block's dictionary in order: number of ids, ids as text, pieces as text."""
        if not got:
            return np.zeros(0, np.int64), pa.array([], pa.large_binary()), pa.array([], pa.large_binary())
        sizes, flat = (np.concatenate([got[b][k] for b in sorted(got)]) for k in (0, 1))
        sizes = sizes.astype(np.int64)
        once, flat = np.unique(flat, return_inverse=True)
        ends, flat = np.cumsum(sizes), flat.astype(np.uint32)
        strings = ([str(i).encode() for i in once.tolist()], [piece[i] for i in once.tolist()])
        return sizes, *(_joined(pa.array(some, pa.large_binary()), flat, ends) for some in strings)

    return rows.repartition("block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(lean(run), schema)


def encode(docs: DataFrame, file: str = FILE) -> DataFrame:
    """(doc_id, text) -> doc_id, ids array<int>, decoded string."""

    def result(doc_ids, n, ids, decoded):
        flat = pa.array([[int(x) for x in one.split()] for one in ids], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([doc_ids, flat, pa.array(decoded, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return assembled(docs, file, result, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, file: str = FILE, most: int | None = None) -> DataFrame:
    """(doc_id, text) -> counts and digests of ids and decoded text."""

    def result(doc_ids, n, ids, decoded):
        sha = [pa.array([hashlib.sha256(x).hexdigest() for x in some], pa.string()) for some in (ids, decoded)]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(n.astype(np.int64)), *sha], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return assembled(docs, file, result, DIGESTS, most)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
