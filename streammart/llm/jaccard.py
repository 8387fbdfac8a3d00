"""N-gram Jaccard join with multiple global orders.

Documents are sets of hashed word shingles; equal sets are one node. Two sets of Jaccard similarity s
or more share a token within their prefixes (the first n - ceil(s n) + 1 tokens) under EVERY global
token order, so a candidate pair must share a prefix token under all of ``ORDERS`` orders before its
sets are compared. All orders put tokens that many documents hold last, by their counts; they order
the rest differently. The first order's prefixes are indexed by token; in a token's bucket, the sets
with the fewest rarer tokens are hubs: all others are paired with them first and components are
contracted, so that a group of thousands of near copies gives about two links each and not all its
pairs; a second wave pairs what still isn't connected. Size and position bounds prune pairs without loss.
Then the filters of all orders are intersected: a pair meets the two sets' prefixes under every other
order and a parity bitmap (its differing bits never exceed the sets' difference), and only pairs that
pass them all are joined with the sets themselves, which decide.

Defined results: case is folded for A-Z; null and empty texts and those without a word have the empty
set and are linked with nothing; fewer words than a shingle make one shingle; a null doc_id takes part
and its component is named by the others (null if alone); rows with equal doc_id are rows of their
own; an empty table gives no rows; other columns are ignored; ill-formed UTF-8 counts as its bytes.
Tokens are 64-bit hashes, kept to 48; sets are told apart by 128-bit digests of the 64-bit ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streammart.llm.common import BROADCAST_KEYS, drop_staged, hand_back, local, spread, staged, table
from streammart.llm.components import components
from streammart.llm.tokens import lean, sliced, texts

NAME = "op4_jaccard_orders"
WORDS, PERCENT, ORDERS = 4, 85, 3
#: Frequent tokens: at most so many, with at least so many copies counted within partitions.
HOT_TOKENS, HOT_COPIES = 200_000, 16
#: Words whose hashes are remembered at a time (any others are hashed again), and bytes of text shingled at a time.
HASHED_WORDS, TEXT_BYTES = 1 << 16, 1 << 20
#: Rows of a bucket that each wave pairs with all after them, from and to.
WAVES = ((0, 2), (2, 1 << 40))
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashes(dict):
    """word -> 64-bit hash, each word hashed once while it stays in the table."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HASHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_sets(found: list[bytes], words: int, known: Hashes) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text; the words of one text at a time are objects."""
    parts, short = [], {}
    for i, t in enumerate(found):
        ws = t.lower().split()
        parts.append(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)))
        if 0 < len(ws) < words:
            short[i] = xxhash.xxh64_intdigest(b" ".join(ws), seed=len(ws))
    flat = np.concatenate([np.zeros(0, np.uint64), *parts])
    sizes = list(map(len, parts))
    del parts
    rolled = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for i in range(words):
        rolled = mix(rolled * _C[0] + flat[i : i + len(rolled)] + _C[i % 4])
    out, at = [], 0
    for i, n in enumerate(sizes):
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        else:
            out.append(np.array([short[i]] if n else [], np.uint64))
        at += n
    return out


def packed(tokens: np.ndarray) -> bytes:
    """48-bit tokens, six bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in each of m slots, m a power of two not below their number (up to 2^16)."""
    m = min(1 << 16, max(256, 1 << int(len(tokens) - 1).bit_length()))
    slots = (mix(tokens) & np.uint64(m - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Differing bits of two bitmaps, the larger folded to the smaller: at most the sets' difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x = np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)
    y = np.bitwise_xor.reduce(y.reshape(-1, size), axis=0)
    return int(np.unpackbits(x ^ y).sum())


def least_overlap(a, b, percent: int):
    """The least intersection of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n, percent: int):
    return n - -(-percent * n // 100) + 1


def ordered(tokens: np.ndarray, hot: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """``tokens`` (ascending) in global order k: rare ones by a hash of their own, then hot ones by count."""
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        is_hot = hot[at] == tokens
        rare, late = tokens[~is_hot], tokens[is_hot]
        late = late[np.argsort(rank[at[is_hot]], kind="stable")]
    else:
        rare, late = tokens, tokens[:0]
    if k:
        rare = rare[np.argsort(mix(rare * _C[k % 4] + np.uint64(k)), kind="stable")]
    return np.concatenate([rare, late])


def sets(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, ..) -> rid (of the row), doc_id, ``keep`` columns, n, name (digest of the set), bits, tokens (packed)."""

    def run(batches):
        known, rid = Hashes(), TaskContext.get().partitionId() << 36
        for batch in sliced(batches, size=TEXT_BYTES):
            found = shingle_sets(list(texts(batch)), words, known)
            cut = [x >> np.uint64(16) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(rid, rid + len(found)), pa.int64()),
                    *(batch.column(c) for c in ("doc_id", *keep)),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes(), seed=len(x)) for x in found], pa.binary()),
                    pa.array([bitmap(x) if len(x) else b"" for x in cut], pa.binary()),
                    pa.array([packed(x) for x in cut], pa.binary()),
                ],
                ["rid", "doc_id", *keep, "n", "name", "bits", "tokens"],
            )
            rid += len(found)

    rows = docs.select(F.col("doc_id").cast("long"), *keep, F.col("text").cast("string"))
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(lean(run), f"rid long, doc_id long{kept}, n long, name binary, bits binary, tokens binary")


def named(found: DataFrame) -> DataFrame:
    """name, node, n, doc_id: each distinct set once; its node is the least rid that holds it."""
    some = found.groupBy("name").agg(F.min("rid").alias("node"), F.first("n").alias("n"), F.min("doc_id").alias("doc_id"))
    return staged(some, "names")


def _copies(batches):
    """Tokens that a part of the table holds twice or more, with their numbers."""

    def counted(parts):
        token, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token[n > 1].astype(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["token", "copies"])

    parts, held = [], 0
    for batch in batches:
        for raw in batch.column("tokens"):
            parts.append(unpacked(raw.as_py()))
            held += len(parts[-1])
        if held > 1_000_000:
            yield counted(parts)
            parts, held = [], 0
    if parts:
        yield counted(parts)


def hot_tokens(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, ascending, and the rank of each by count: a bounded list."""
    rows = (
        found.select("tokens")
        .mapInArrow(lean(_copies), "token long, copies long")
        .groupBy("token")
        .agg(F.sum("copies").alias("copies"))
        .filter(F.col("copies") >= HOT_COPIES)
        .orderBy(F.desc("copies"), "token")
        .limit(HOT_TOKENS)
        .toArrow()
    )
    token = rows.column("token").to_numpy().astype(np.uint64)
    rank = np.arange(len(token), 0, -1)  # the most frequent comes last
    order = np.argsort(token)
    return token[order], rank[order]


def prefixes(found: DataFrame, hot, percent: int) -> DataFrame:
    """The first order's index: token, n, node, pos (its place in the set's order)."""

    def run(batches):
        tokens, rank = hot.value
        for batch in batches:
            out = []
            for n, node, raw in zip(batch.column("n").to_pylist(), batch.column("node").to_pylist(), batch.column("tokens"), strict=True):
                if n:
                    mine = ordered(unpacked(raw.as_py()), tokens, rank, 0)[: prefix_size(n, percent)]
                    out.append((mine, n, node))
                if len(out) >= 2000:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    def rows(out):
        size = [len(x[0]) for x in out]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([x[0] for x in out]).astype(np.int64)),
                pa.array(np.repeat(np.array([x[1] for x in out], np.int32), size)),
                pa.array(np.repeat(np.array([x[2] for x in out], np.int64), size)),
                pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in size])),
            ],
            ["token", "n", "node", "pos"],
        )

    return found.select("n", "node", "tokens").mapInArrow(lean(run), "token long, n int, node long, pos int")


def _grouped(batches, columns):
    """Sorted batches -> dicts of arrays that each hold whole buckets (runs of equal token)."""
    held = None
    for batch in batches:
        part = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        if held is not None:
            part = {c: np.concatenate([held[c], part[c]]) for c in columns}
        last = int(np.searchsorted(part["token"], part["token"][-1])) if len(part["token"]) else 0
        held = {c: part[c][last:] for c in columns}
        if last:
            yield {c: part[c][:last] for c in columns}
    if held is not None and len(held["token"]):
        yield held


def members(index: DataFrame, percent: int) -> DataFrame:
    """Index rows that can take part in a link: token, n, node, pos, size (rows of its bucket)."""

    def run(batches):
        for x in _grouped(batches, ("token", "n", "node", "pos")):
            new = np.concatenate([[True], (x["token"][1:] != x["token"][:-1]) | (x["node"][1:] != x["node"][:-1])])
            x = {c: v[new] for c, v in x.items()}
            first = np.concatenate([[True], x["token"][1:] != x["token"][:-1]])
            bucket = np.cumsum(first) - 1
            n = x["n"].astype(np.int64)
            partner = np.maximum(n[first][bucket], -(-percent * n // 100))  # the least size that could link
            alive = (x["pos"] <= n - least_overlap(n, partner, percent)) & (np.bincount(bucket)[bucket] > 1)
            size = np.bincount(bucket[alive], minlength=len(first))[bucket]
            alive &= size > 1
            if alive.any():
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[c][alive]) for c in ("token", "n", "node", "pos")), pa.array(size[alive].astype(np.int64))],
                    ["token", "n", "node", "pos", "size"],
                )

    return index.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(lean(run), "token long, n int, node long, pos int, size long"
    )


def paired(rows: DataFrame, low: int, high: int, percent: int) -> DataFrame:
    """Pairs (a < b) of a bucket's hubs, its low-th to high-th rows, with the rows after them.

    Rows are in order of position: those with the fewest rare tokens of their own come first, and a
    group's common core leads. At the first token that two sets share, all tokens before it differ, so
    the two positions together can't exceed the difference that linked sets of these sizes may have.
    Pairs within one component are left out.
    """

    def run(batches):
        for x in _grouped(batches, ("token", "n", "node", "pos", "root")):
            n, pos = x["n"].astype(np.int64), x["pos"].astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], x["token"][1:] != x["token"][:-1]]))
            size = np.diff(np.append(cuts, len(n)))
            at = np.arange(len(n))
            start = np.repeat(cuts, size)
            later = np.repeat(np.arange(len(cuts), 0, -1), size) << 32  # buckets apart in one running maximum
            most = np.maximum.accumulate((n + later)[::-1])[::-1] - later  # the largest set from each row on
            for r in range(low, min(high, int(size.max()) - 1)):
                at, start = at[start + r < at], start[start + r < at]
                hub = start + r
                # Positions only rise: a row that is too far from this hub for the largest partner left to it
                # has none among the later rows either. Other rows stay, whatever this hub's own size allows.
                partner = np.minimum(most[hub], 100 * n[at] // percent)
                near = pos[hub] + pos[at] <= (100 - percent) * (n[at] + partner) // (100 + percent)
                at, start = at[near], start[near]
                if not len(at):
                    break
                hub = start + r
                need = least_overlap(n[hub], n[at], percent)
                ok = (
                    (x["root"][hub] != x["root"][at])
                    & (100 * np.minimum(n[hub], n[at]) >= percent * np.maximum(n[hub], n[at]))
                    & (pos[hub] + pos[at] <= n[hub] + n[at] - 2 * need)
                    & (pos[hub] <= n[hub] - need)
                    & (pos[at] <= n[at] - need)
                )
                if ok.any():
                    a, b = x["node"][hub[ok]], x["node"][at[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    sorted_rows = rows.repartition("token").sortWithinPartitions("token", "pos", "node")
    return sorted_rows.mapInArrow(lean(run), "a long, b long").distinct()


def _needed(found: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``found`` whose node is in ``pairs``."""
    nodes = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    few = nodes.count() <= BROADCAST_KEYS
    return found.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").select("node", *columns)


def _both(some: DataFrame, part: DataFrame) -> DataFrame:
    """Pairs with the columns of ``part`` for either end."""
    left = part.select(F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in part.columns[1:]))
    right = part.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in part.columns[1:]))
    return some.join(left, "a").join(right, "b")


def signatures(found: DataFrame, hot, percent: int) -> DataFrame:
    """(node, n, bits, tokens) -> node, n, bits and the prefixes under the orders after the first.

    A prefix travels as 16 bits of each token: a pair may pass a filter by chance, but never fail it so.
    """

    def run(batches):
        tokens, rank = hot.value
        for batch in batches:
            sets_ = [unpacked(x.as_py()) for x in batch.column("tokens")]
            cuts = [
                pa.array([np.unique(ordered(x, tokens, rank, k)[: prefix_size(len(x), percent)].astype("<u2")).tobytes() for x in sets_], pa.binary())
                for k in range(1, ORDERS)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "n", "bits")), *cuts], ["node", "n", "bits", *names])

    names = [f"prefix{k}" for k in range(1, ORDERS)]
    return found.select("node", "n", "bits", "tokens").mapInArrow(lean(run), ", ".join(["node long, n long, bits binary", *(f"{c} binary" for c in names)]))


def passed(pairs: DataFrame, found: DataFrame, hot, percent: int) -> DataFrame:
    """a, b, orders: under how many orders in turn the pair shares a prefix token; ORDERS + 1 if the bitmaps agree too."""

    def run(batches):
        for batch in batches:
            out = np.ones(batch.num_rows, np.int32)
            for k in range(1, ORDERS):
                left, right = batch.column(f"prefix{k}_a"), batch.column(f"prefix{k}_b")
                for i in np.flatnonzero(out == k).tolist():
                    x, y = np.frombuffer(left[i].as_py(), "<u2"), np.frombuffer(right[i].as_py(), "<u2")
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    out[i] += bool((x[at] == y).any())
            bits = (batch.column("bits_a"), batch.column("bits_b"))
            m, n = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            room = m + n - 2 * least_overlap(m, n, percent)
            for i in np.flatnonzero(out == ORDERS).tolist():
                out[i] += differing(bits[0][i].as_py(), bits[1][i].as_py()) <= room[i]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "orders"])

    part = signatures(_needed(found, pairs, ["n", "bits", "tokens"]), hot, percent)
    return _both(pairs, part).mapInArrow(lean(run), "a long, b long, orders int")


def verified(pairs: DataFrame, found: DataFrame, hot, percent: int) -> DataFrame:
    """The pairs that link: all orders' filters first, then the sets of the pairs that pass them."""

    def by_sets(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
                x, y = unpacked(x.as_py()), unpacked(y.as_py())
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    close = staged(passed(pairs, found, hot, percent).filter(F.col("orders") > ORDERS).select("a", "b"), "close")
    return _both(close, _needed(found, close, ["tokens"])).mapInArrow(lean(by_sets), "a long, b long")


def indexed(docs: DataFrame, words: int, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows' sets, the distinct sets (node, n, bits, tokens), and their names."""
    every = staged(sets(docs, words, keep), "sets")
    names = named(every)
    nodes, few = names.select(F.col("node").alias("rid")), names.count() <= BROADCAST_KEYS
    found = every.join(F.broadcast(nodes) if few else nodes, "rid", "left_semi")
    return every, found.select(F.col("rid").alias("node"), "n", "bits", "tokens"), names


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, ..) -> doc_id, ``keep`` columns, n_shingles, root (of the component), component_id."""
    spark = docs.sparkSession
    every, found, names = indexed(docs, words, keep)
    hand_back(spark)
    hot = spark.sparkContext.broadcast(hot_tokens(found))
    held = staged(members(prefixes(found, hot, percent), percent), "members")
    hand_back(spark)
    links = None
    roots = local(spark, node=pa.array([], pa.int64()), root=pa.array([], pa.int64()))
    largest = held.agg(F.max("size")).first()[0] or 0
    for low, high in WAVES:
        if largest <= low + 1:
            break
        rows = held.filter(F.col("size") > low + 1).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = staged(paired(rows, low, high, percent), "pairs")
        hand_back(spark)
        new = staged(verified(pairs, found, hot, percent), "links")
        drop_staged(pairs)
        links = new if links is None else links.unionByName(new)
        roots = components(links)
        hand_back(spark)
    # Components are named over distinct sets, whose rows have been counted together; copies come last.
    nodes = staged(names.join(roots, "node", "left").select("name", F.coalesce("root", "node").alias("root"), F.col("node").alias("rid"), "doc_id"), "roots")
    least = staged(nodes.groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    sides = staged(spread(nodes.select("name", "root", "rid"), least, ["root"], ["rid"], most=BROADCAST_KEYS).select("name", "root", "least"), "sides")
    rows = spread(every.select("rid", "doc_id", *keep, "n", "name"), sides, ["name"], ["rid"], most=BROADCAST_KEYS).select(
        "doc_id",
        *keep,
        F.col("n").alias("n_shingles"),
        "root",
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    result = staged(rows, "joined")  # some tens of bytes a document; the sets go
    for old in (every, held, names, nodes, least, sides):
        drop_staged(old)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM d
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
links AS (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rid != y.rid GROUP BY ALL)
  JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach AS (
  SELECT rid AS a, rid AS b FROM d
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) JOIN reach ON reach.a = d.rid JOIN d o ON o.rid = reach.b GROUP BY d.rid, d.doc_id, n.n
"""
