"""Duplicate passages by prefix-free parsing.

Parsing: a rolling hash runs over every ``GRAM`` bytes; a position is a trigger where its hash is the
least of some window of ``LENGTH`` bytes. A phrase is a run of windows with one trigger (of ``MOST`` windows
at most), with the bytes under them, so neighbouring phrases overlap by LENGTH - 1 bytes and every LENGTH-byte
string of the corpus lies in exactly one phrase, under a trigger that its own bytes fix. The dictionary holds
each distinct phrase once, with the least document that holds it; the parse says where phrases stand.

Corpus order: within a trigger's bucket, the suffixes of distinct phrases that aren't alone with their first
LENGTH bytes are sorted by these bytes; equal neighbours give the least document of each string. A match
of LENGTH bytes never reaches past its phrase, so the order of what follows a phrase (the parse's own suffix
array) decides nothing here and isn't made. The dictionary is solved once for each distinct phrase, and what
it says goes back to the blocks of documents that sent the phrase: a document loses a phrase whole if all
its strings have a smaller document; the least document of a phrase loses the runs that another phrase's
smaller document has. So a passage that all documents hold costs a block one phrase, however many documents.

Scale: a first pass over the texts sends only (trigger, document) pairs, 6 to 8 bytes each, to find
triggers of two documents or more; their bitmap, of a size between fixed bounds (``BITS``), is broadcast,
a second pass sends the distinct phrases under them, and a third the parse, block by block, to meet the
replies. A full bitmap costs traffic, never results. Texts aren't shuffled; long ones are parsed in pieces.
Passes must see rows in one order: files do, anything else is written to the shared folder first.

Defined results: null text is empty; texts shorter than LENGTH keep everything; a null doc_id takes no
part and loses nothing; rows with equal doc_id don't deduplicate one another, nor a row itself; an
empty table gives no rows; other columns are ignored; whole texts count, as the bytes they have, well-formed
UTF-8 or not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streammart.llm.common import planned_bytes, replayable, staged, table
from streammart.llm.tokens import lean, texts

NAME = "op6_prefix_free_dedup"
LENGTH, GRAM = 50, 16
SLICE, FLUSH = 1 << 19, 1 << 19
#: Windows of a phrase at most.
MOST = 4096
#: Leading bits of a trigger that name its bucket: eight buckets for each shuffle partition, between these.
BUCKETS = (8, 22)
_LAST = np.iinfo(np.int64).max
#: Least and greatest size of the broadcast bitmap: 2^22 bits are 0.5 MB, 2^30 bits 128 MB.
BITS = (22, 30)
#: Interval tables up to this size are broadcast to the last pass; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _loads(buffer: bytes, n: int, offset: int) -> np.ndarray:
    """The 8 bytes from each of n places on, as integers."""
    return np.ndarray((n,), "<u8", buffer, offset, (1,))


def fingerprints(buffer: bytes, n: int, length: int = LENGTH) -> np.ndarray:
    """Of the ``length`` bytes from each of the first n places on (the buffer is padded)."""
    x = np.full(n, length, np.uint64)
    for at in [*range(0, length - 8, 8), length - 8]:
        x = (x ^ (x >> np.uint64(29))) * _C[0] + _loads(buffer, n, at) * _C[1]
    return mix(x)


def parse(pieces: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Phrases of the texts (or pieces of them): buffer, document index, first window, window after the last, trigger.

    Places are offsets in ``buffer``, the texts one after another; also each text's offset.
    """
    sizes = np.array([len(t) for t in pieces], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    buffer = b"".join([*pieces, b"\0" * (length + 16)])
    n = int(offsets[-1])
    if n < length:
        none = np.zeros(0, np.int64)
        return buffer, offsets, none, none, none, np.zeros(0, np.uint64)
    span = length - gram + 1
    m = mix(_loads(buffer, n, 0) * _C[0] + _loads(buffer, n, gram - 8) * _C[1])
    width = 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[: -(span - width)], m[span - width :])
    windows = np.maximum(sizes - length + 1, 0)
    cut = np.zeros(n, bool)
    cut[1 : len(m)] = m[1:] != m[:-1]
    cut[offsets[:-1][windows > 0]] = True
    at = np.flatnonzero(cut)
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = at - offsets[doc] < windows[doc]
    at, doc = at[inside], doc[inside]
    end = np.minimum(np.append(at[1:], n), offsets[doc] + windows[doc])
    trigger = mix(m[at] ^ _C[2])
    parts = -(-(end - at) // MOST)
    if (parts > 1).any():  # long runs of one trigger, as in padding, are many equal phrases
        row = np.repeat(np.arange(len(at)), parts)
        step = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = at[row] + step * MOST
        at, end, doc, trigger = begin, np.minimum(begin + MOST, end[row]), doc[row], trigger[row]
    return buffer, offsets, doc, at, end, trigger


def key_of(digest: bytes) -> int:
    """What tells rows of one doc_id apart: 64 bits of the text's digest."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _batches(batches, size: int | None = None):
    """Rows with a doc_id whose text can hold a window, in slices: doc_ids, text keys, offsets, texts, copies.

    Texts come in pieces of SLICE windows. Within a task a text that a smaller doc_id has shown before
    comes as a copy (doc_id, key, length).
    """
    size = size or SLICE
    seen: dict[bytes, int] = {}
    ids, keys, at, pieces, copies, held = [], [], [], [], [], 0
    for batch in batches:
        for i, raw in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            if i is None or len(raw) < LENGTH:
                continue
            digest = xxhash.xxh3_128_digest(raw)
            if seen.get(digest, i) < i:
                copies.append((i, key_of(digest), len(raw)))
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen[digest] = i
            for begin in range(0, len(raw) - LENGTH + 1, size):
                ids.append(i)
                keys.append(key_of(digest))
                at.append(begin)
                pieces.append(raw[begin : begin + size + LENGTH - 1])
                held += len(pieces[-1])
                if held >= size:
                    yield np.array(ids, np.int64), np.array(keys, np.int64), np.array(at, np.int64), pieces, copies
                    ids, keys, at, pieces, copies, held = [], [], [], [], [], 0
    if pieces or copies:
        yield np.array(ids, np.int64), np.array(keys, np.int64), np.array(at, np.int64), pieces, copies


def _bucket(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def _by_bucket(batches):
    """Rows sorted by bucket -> (bucket, its rows), one bucket at a time."""
    bucket, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: v[0] for c, v in batch.slice(i, 1).to_pydict().items()}
            if row["bucket"] != bucket and rows:
                yield bucket, rows
                rows = []
            bucket = row["bucket"]
            rows.append(row)
    if rows:
        yield bucket, rows


def bitmap_bits(docs: DataFrame) -> int:
    """Leading bits of a trigger that address the bitmap: several for each trigger, by the planner's size."""
    return min(BITS[1], max(BITS[0], (planned_bytes(docs) // 2).bit_length()))


def repeated_triggers(docs: DataFrame, bits: int, total: int) -> np.ndarray:
    """Bitmap of the triggers that two documents or more hold, by their ``total`` leading bits."""

    def send(batches):
        held, rows = [], 0

        def flush():
            t = np.concatenate([x[0] for x in held])
            ids, doc = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True)
            order = np.argsort(t, kind="stable")
            t, doc = t[order], doc[order].astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)
            bucket = _bucket(t, bits)
            cuts = _cuts(bucket)
            low = ((t << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            parts = list(zip(cuts, cuts[1:], strict=False))
            packed = []
            for i, j in parts:
                mine, index = np.unique(doc[i:j], return_inverse=True)
                packed.append((low[i:j].tobytes(), ids[mine].tobytes(), index.astype(np.uint16 if len(mine) <= 1 << 16 else np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts[:-1]]), *(pa.array([p[k] for p in packed], pa.binary()) for k in range(3))], ["bucket", "low", "ids", "doc"]
            )

        for ids, _, _, pieces, _ in _batches(batches):
            _, _, doc, _, _, trigger = parse(pieces)
            if len(doc):
                held.append((trigger, ids[doc]))
                rows += len(doc)
            if rows >= FLUSH:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    def meet(batches):
        for b, rows in _by_bucket(batches):
            parts = []
            for row in rows:
                ids = np.frombuffer(row["ids"], np.int64)
                doc = np.frombuffer(row["doc"], np.uint16 if len(ids) <= 1 << 16 else np.uint32)
                parts.append((np.frombuffer(row["low"], np.uint32), ids[doc]))
            low, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(low, kind="stable")
            low, doc = low[order], doc[order]
            cuts = _cuts(low)[:-1]
            many = np.minimum.reduceat(doc, cuts) < np.maximum.reduceat(doc, cuts)
            places = np.unique(low[cuts][many] >> np.uint32(32 - (total - bits)))
            if len(places):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([places.astype(np.uint32).tobytes()], pa.binary())], ["bucket", "places"])

    sent = docs.select("doc_id", "text").mapInArrow(lean(send), "bucket long, low binary, ids binary, doc binary")
    rows = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), "bucket long, places binary")

    def folded(batches):  # as bits, so that what reaches the driver is bounded by the bitmap
        for batch in batches:
            for b, places in zip(batch.column("bucket").to_pylist(), batch.column("places").to_pylist(), strict=True):
                held = np.zeros(1 << (total - bits), bool)
                held[np.frombuffer(places, np.uint32)] = True
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([np.packbits(held).tobytes()], pa.binary())], ["bucket", "bits"])

    out = np.zeros((1 << bits, (1 << (total - bits)) // 8), np.uint8)
    for b, raw in rows.mapInArrow(lean(folded), "bucket long, bits binary").toLocalIterator():
        out[b] = np.frombuffer(raw, np.uint8)
    return out.ravel()


class Block:
    """Phrases of some documents in order: the parse (one entry each) and the distinct phrases by bucket."""

    def __init__(self, held: list[dict], bits: int):
        x = {c: np.concatenate([h[c] for h in held]) for c in ("trigger", "id", "key", "start", "count")}
        number: dict[bytes, int] = {}
        no = np.fromiter((number.setdefault(c, len(number)) for h in held for c in h["content"]), np.int64, len(x["id"]))
        first = np.unique(no, return_index=True)[1]
        least, most = np.full(len(number), _LAST), np.full(len(number), -_LAST - 1)
        np.minimum.at(least, no, x["id"])
        np.maximum.at(most, no, x["id"])
        bucket = _bucket(x["trigger"][first], bits)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        content = list(number)
        self.content, self.least, self.most, self.bucket = [content[i] for i in order.tolist()], least[order], most[order], bucket[order]
        self.parse = np.stack([x["id"], x["key"], x["start"], x["count"], place[no]])
        self.name = xxhash.xxh3_128_digest(x["trigger"].tobytes() + self.parse.tobytes())
        self.cuts = _cuts(self.bucket).tolist()


def _blocks(batches, bitmap, bits: int, total: int):
    """Blocks of the phrases under repeated triggers, and copies found within the task, by turns (one is None)."""
    held, rows = [], 0
    for ids, keys, base, pieces, copies in _batches(batches):
        if copies:
            yield None, copies
        buffer, offsets, doc, at, end, trigger = parse(pieces)
        place = (trigger >> np.uint64(64 - total)).astype(np.int64)
        ok = np.flatnonzero((bitmap.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
        if not len(ok):
            continue
        doc, at, end, trigger = doc[ok], at[ok], end[ok], trigger[ok]
        content = [buffer[i:j] for i, j in zip(at.tolist(), (end + LENGTH - 1).tolist(), strict=True)]
        start = at - offsets[doc] + base[doc]
        held.append({"trigger": trigger, "id": ids[doc], "key": keys[doc], "start": start, "count": end - at, "content": content})
        rows += len(ok)
        if rows >= FLUSH // 4:  # phrases carry their bytes
            yield Block(held, bits), None
            held, rows = [], 0
    if held:
        yield Block(held, bits), None


def dictionary(docs: DataFrame, bitmap, bits: int, total: int) -> DataFrame:
    """bucket, block, first (number of a block's first phrase in the bucket), least, most (documents), sizes, content."""

    def run(batches):
        zstd = zstandard.ZstdCompressor(level=1)
        for block, _ in _blocks(batches, bitmap, bits, total):
            if block is None:
                continue
            parts = list(zip(block.cuts, block.cuts[1:], strict=False))
            sizes = np.fromiter(map(len, block.content), np.int64, len(block.content))
            columns = [[zstd.compress(v[i:j].tobytes()) for i, j in parts] for v in (block.least, block.most, sizes)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.bucket[block.cuts[:-1]]),
                    pa.array([block.name] * len(parts), pa.binary()),
                    pa.array([i for i, _ in parts], pa.int64()),
                    *(pa.array(c, pa.binary()) for c in columns),
                    pa.array([zstd.compress(b"".join(block.content[i:j])) for i, j in parts], pa.binary()),
                ],
                ["bucket", "block", "first", "least", "most", "sizes", "content"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "bucket long, block binary, first long, least binary, most binary, sizes binary, content binary")


def _least_documents(contents: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of distinct phrases, one after another: the least document of each; windows of each phrase."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    windows, begins = sizes - LENGTH + 1, np.cumsum(sizes) - sizes
    buffer = b"".join([*contents, b"\0" * 64])
    phrase = np.repeat(np.arange(len(contents)), windows)
    place = np.arange(len(phrase)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[phrase]
    smallest = least[phrase]
    # A suffix whose fingerprint is alone is alone with its bytes; the others are put in byte order.
    prints = fingerprints(buffer, int(sizes.sum()))[place]
    order = np.argsort(prints, kind="stable")
    same = prints[order][1:] == prints[order][:-1]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if len(order):
        at = place[order]
        words = [np.ndarray((int(sizes.sum()),), ">u8", buffer, offset, (1,))[at].astype(np.uint64) for offset in (*range(0, LENGTH - 8, 8), LENGTH - 8)]
        by_bytes = np.lexsort(words[::-1])
        differ = np.zeros(len(order) - 1, bool)
        for w in words:
            differ |= w[by_bytes][1:] != w[by_bytes][:-1]
        cuts = np.concatenate([[0], np.flatnonzero(differ) + 1, [len(order)]])
        order = order[by_bytes]
        held = np.minimum.reduceat(smallest[order], cuts[:-1])
        smallest[order] = np.repeat(held, np.diff(cuts))
    return smallest, windows


def _solved(rows: list[dict], zip_, unzip):
    """Of one bucket: for each block's row, what its documents lose: (block, numbers and bounds, runs)."""
    number: dict[bytes, int] = {}
    parts = []
    for row in rows:
        least, most, sizes = (np.frombuffer(unzip.decompress(row[c]), np.int64) for c in ("least", "most", "sizes"))
        content, ends = unzip.decompress(row["content"]), np.cumsum(sizes).tolist()
        own = [number.setdefault(content[i:j], len(number)) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        parts.append((row, least, most, np.array(own, np.int64)))
    least = np.full(len(number), _LAST)
    for _, mine, _, own in parts:
        np.minimum.at(least, own, mine)
    smallest, windows = _least_documents(list(number), least)
    begins = np.cumsum(windows) - windows
    bound = np.maximum.reduceat(smallest, begins)  # documents above it lose the phrase whole
    hit = smallest < np.repeat(least, windows)
    new = hit & ~np.concatenate([[False], hit[:-1]])
    new[begins] |= hit[begins]
    last = hit & ~np.concatenate([hit[1:], [False]])
    last[begins + windows - 1] |= hit[begins + windows - 1]
    a, b = np.flatnonzero(new), np.flatnonzero(last) + 1
    owner = np.searchsorted(begins, a, "right") - 1
    a, b = a - begins[owner], b - begins[owner]
    for row, mine, most, own in parts:
        whole = np.flatnonzero(bound[own] < most)
        first = np.flatnonzero(mine == least[own])  # phrases whose least document is here
        lo, hi = np.searchsorted(owner, own[first]), np.searchsorted(owner, own[first], "right")
        n = hi - lo
        pick = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        runs = np.stack([np.repeat(first, n) + row["first"], a[pick], b[pick]])
        yield row["block"], zip_.compress(np.stack([whole + row["first"], bound[own[whole]]]).tobytes()), zip_.compress(runs.tobytes())


def solutions(found: DataFrame) -> DataFrame:
    """block, bounds (phrase number, document above which it goes whole), runs (phrase number, from, to)."""

    def run(batches):
        zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for _, rows in _by_bucket(batches):
            block, bounds, runs = zip(*_solved(rows, zip_, unzip), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (block, bounds, runs)], ["block", "bounds", "runs"])

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "block binary, bounds binary, runs binary")


def parses(docs: DataFrame, bitmap, bits: int, total: int) -> DataFrame:
    """block, parse, rows (of the block in the dictionary); copies come under a null block."""

    def run(batches):
        zstd = zstandard.ZstdCompressor(level=1)
        for block, copies in _blocks(batches, bitmap, bits, total):
            if block is not None:
                name, parse_, rows = block.name, block.parse, len(block.cuts) - 1
            else:
                name, parse_, rows = b"", np.array(copies, np.int64).T, TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.binary()), pa.array([zstd.compress(np.ascontiguousarray(parse_).tobytes())], pa.binary()), pa.array([rows], pa.int32())],
                ["block", "parse", "rows"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "block binary, parse binary, rows int")


def _lost(parse_: np.ndarray, bounds: list[np.ndarray], runs: list[np.ndarray]) -> list[np.ndarray]:
    """Of one block: id, key, from, to of the byte runs that its documents lose."""
    i, key, start, count, no = parse_
    bound = np.full(int(no.max()) + 1, _LAST)
    numbers, values = np.concatenate(bounds, axis=1)
    bound[numbers] = values
    whole = i > bound[no]
    out = [[x[whole] for x in (i, key, start, start + count + LENGTH - 1)]]
    runs = np.concatenate(runs, axis=1)
    runs = runs[:, np.argsort(runs[0], kind="stable")]
    rest = np.flatnonzero(~whole)
    lo, hi = np.searchsorted(runs[0], no[rest]), np.searchsorted(runs[0], no[rest], "right")
    n = hi - lo
    pick, row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), np.repeat(rest, n)
    out.append([i[row], key[row], start[row] + runs[1][pick], start[row] + runs[2][pick] + LENGTH - 1])
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def removals(solved: DataFrame, parsed: DataFrame, shares: int) -> DataFrame:
    """doc_id, hash, spans: each document's byte runs to remove, merged, as packed integers."""

    def lose(batches):
        zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

        def send(got):
            share = (mix(got[1].astype(np.uint64)) % np.uint64(shares)).astype(np.int64)
            order = np.lexsort((got[2], got[1], got[0], share))
            got, share = [g[order] for g in got], share[order]
            cuts = _cuts(share)
            rows = [zip_.compress(np.stack([g[i:j] for g in got]).tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(share[cuts[:-1]]), pa.array(rows, pa.binary())], ["share", "runs"])

        name, bounds, runs = None, [], []
        for batch in batches:
            for k in range(batch.num_rows):
                block, raw = batch.column("block")[k].as_py(), batch.column("parse")[k].as_py()
                if block != name:
                    name, bounds, runs = block, [], []
                if raw is None:
                    for c, held, width in (("bounds", bounds, 2), ("runs", runs, 3)):
                        held.append(np.frombuffer(unzip.decompress(batch.column(c)[k].as_py()), np.int64).reshape(width, -1))
                    continue
                if not block:  # copies of whole texts
                    i, key, size = np.frombuffer(unzip.decompress(raw), np.int64).reshape(3, -1)
                    yield send([i, key, np.zeros(len(i), np.int64), size])
                    continue
                if len(bounds) % batch.column("rows")[k].as_py() or not bounds:
                    raise RuntimeError("a block of documents has no reply: its rows came in another order when read again")
                got = _lost(np.frombuffer(unzip.decompress(raw), np.int64).reshape(5, -1), bounds, runs)
                if len(got[0]):
                    yield send(got)

    def merge(batches):
        unzip, parts = zstandard.ZstdDecompressor(), []
        for batch in batches:
            parts += [np.frombuffer(unzip.decompress(x), np.int64).reshape(4, -1) for x in batch.column("runs").to_pylist()]
        if not parts:
            return
        ids, h, start, end = np.concatenate(parts, axis=1)
        order = np.lexsort((start, h, ids))
        ids, h, start, end = ids[order], h[order], start[order], end[order]
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])])
        doc = np.cumsum(new) - 1
        # Runs that touch or overlap are one: the furthest end so far, document by document.
        shift = doc * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + shift)
        fresh = new | np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
        begin = np.flatnonzero(fresh)
        last = np.append(begin[1:], len(fresh)) - 1
        a, b, owner = start[begin], reach[last] - shift[last], doc[begin]
        cuts = _cuts(owner)
        at = begin[cuts[:-1]]
        spans = [np.stack([a[i:j], b[i:j]]).astype("<i8").tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
        for k in range(0, len(spans), 20_000):
            some = slice(k, k + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at][some]), pa.array(h[at][some]), pa.array(spans[some], pa.binary())], ["doc_id", "hash", "spans"])

    null = lambda kind: F.lit(None).cast(kind)
    replies = solved.select("block", "bounds", "runs", null("binary").alias("parse"), null("int").alias("rows"))
    both = replies.unionByName(parsed.select("block", null("binary").alias("bounds"), null("binary").alias("runs"), "parse", "rows"))
    # Copies have no block: they are dealt by the task that found them.
    where = F.when(F.length("block") > 0, F.xxhash64("block")).otherwise(F.xxhash64("rows"))
    met = both.withColumn("at", where).repartition("at").sortWithinPartitions("block", F.col("parse").isNotNull())
    runs = met.drop("at").mapInArrow(lean(lose), "share long, runs binary")
    return runs.repartition("share").mapInArrow(lean(merge), "doc_id long, hash long, spans binary")


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, hash (of the text), spans: documents with something to remove."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits, total = min(BUCKETS[1], max(BUCKETS[0], (8 * partitions - 1).bit_length())), bitmap_bits(docs.select("doc_id", "text"))
    bitmap = spark.sparkContext.broadcast(repeated_triggers(docs, min(bits, total - 3), total))
    solved = solutions(dictionary(docs, bitmap, bits, total))
    return staged(removals(solved, parses(docs, bitmap, bits, total), 4 * partitions), "spans")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    docs = replayable(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    spans = duplicate_spans(docs)
    size = spans.agg(F.sum(F.length("spans") + 32)).first()[0] or 0

    def hashed(batches):
        for batch in batches:
            h = [key_of(xxhash.xxh3_128_digest(t)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(h, pa.int64())], ["doc_id", "text", "hash"])

    def cut(batches):
        for batch in batches:
            out = []
            for text, raw in zip(texts(batch), batch.column("spans").to_pylist(), strict=True):
                kept, at, lost = [], 0, 0
                runs = np.frombuffer(raw or b"", "<i8").reshape(2, -1).T.tolist()
                for a, b in runs:
                    kept.append(text[at:a])
                    at, lost = b, lost + b - a
                kept.append(text[at:])
                out.append((len(text), lost, len(runs), b"".join(kept)))
            n, lost, runs, kept = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, lost, runs)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    rows = docs.mapInArrow(lean(hashed), "doc_id long, text string, hash long")
    side = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    return rows.join(side, ["doc_id", "hash"], "left").select("doc_id", "text", "spans").mapInArrow(lean(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (
  SELECT rid, doc_id, i, substr(x, 2 * i + 1, 100) AS s
  FROM (SELECT rid, doc_id, x, unnest(range(CAST(length(x) / 2 - 49 AS BIGINT))) AS i FROM d WHERE doc_id IS NOT NULL)
), f AS (SELECT rid, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
r AS (  -- runs of strings that touch or overlap
  SELECT rid, min(i) AS a, max(i) + 50 AS b FROM (
    SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM (
      SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM f))
  GROUP BY rid, run
), k AS (  -- what stands between them
  SELECT rid, substr(x, 2 * a + 1, 2 * (least(b, length(x) // 2) - a)) AS part, a FROM (
    SELECT rid, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS a, a AS b FROM r
    UNION ALL SELECT rid, max(b), 1099511627776 FROM r GROUP BY rid
  ) JOIN d USING (rid)
), j AS (SELECT rid, string_agg(part, '' ORDER BY a) AS kept FROM k GROUP BY rid)
SELECT doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce((SELECT sum(b - a) FROM r WHERE r.rid = d.rid), 0) AS BIGINT) AS n_removed,
  CAST((SELECT count(*) FROM r WHERE r.rid = d.rid) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN j USING (rid)
"""
