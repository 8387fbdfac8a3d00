"""The corpus pipeline, stage by stage, against brute force on its own input."""

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from streammart.llm import bpe, langid
from tests.llm.test_native import spans_by_hand
from tests.llm.test_python import roots_by_hand

DATA = "/root/testdata/sf0.001"


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def redacted(text):
    if text is None:
        return None
    cover = sorted(tuple(map(int, s.split(":")[1:])) for s in spans_by_hand(text).split(",") if s)
    cover += [m.span() for m in re.finditer(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}", text)]
    out, at = [], 0
    for a, b in sorted(cover):
        if a > at or (a == at == 0):
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if cover else text


def taken_by_hand(rows, labels):
    """Times each row is taken."""
    size = [len((r["text"] or "").encode().split()) for r in rows]
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(n for r, n in zip(rows, size, strict=True) if r["source"] == s) for s in sources}
    goal, free, open_ = {}, 1.5 * sum(size), dict(weight)
    while open_:
        over = [s for s in open_ if free * open_[s] / sum(open_.values()) >= 2 * total[s]]
        if not over:
            goal |= {s: free * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in over:
            goal[s] = 2.0 * total[s]
            free -= goal[s]
            del open_[s]
    epochs = [0] * len(rows)
    for s in sources:
        whole = int(goal[s] // total[s]) if total[s] else 0
        rest = goal[s] - whole * total[s]
        mine = []
        for k, r in enumerate(rows):
            if r["source"] == s:
                u = (int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                q = labels.get(r["doc_id"])
                mine.append((-math.log(u) / (1.0 if q is None else 2.0 if q > 0 else 0.5), k, size[k], k))
        ahead = 0
        for _, _, n, k in sorted(mine):
            epochs[k] = whole + (rest > 0 and ahead + n / 2 <= rest)
            ahead += n
    return epochs


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = [(None, "no id here, only words of the text", "en", "src1", 5), (9001, None, "en", None, 0), (9002, "", None, "src1", 0), (9003, "12 34", "en", None, 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("score", F.lit("clash"))
    rows = [r.asDict() for r in docs.collect()]

    model = langid.trained(docs)
    kept = P.identify_language(spark, docs, DATA).cache()
    said = langid.predicted(model, [(r["text"] or "").encode() for r in rows])
    want = [(r["doc_id"], r["text"], s[0], r["source"], r["n_chars"]) for r, s in zip(rows, said, strict=True) if not s[2]]
    assert table(kept) == sorted(want, key=repr) and kept.columns == P.COLUMNS

    unique = P.drop_near_duplicates(spark, kept, DATA).cache()
    assert [r[:2] for r in table(unique)] == sorted(unique_by_hand([(r["doc_id"], r["text"]) for r in kept.collect()]), key=repr)
    assert set(table(unique)) <= set(table(kept))

    clean = P.redact_secrets(spark, unique, DATA).cache()
    want = []
    for i, text, lang, source, n in table(unique):
        new = redacted(text)
        want.append((i, new, lang, source, n if new == text else len(new)))
    assert table(clean) == sorted(want, key=repr)

    mixed = P.mix_sources(spark, clean, DATA).cache()
    rows = [r.asDict() for r in clean.collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    times = taken_by_hand(rows, labels)
    assert table(mixed) == sorted((tuple(r.values()) for r, n in zip(rows, times, strict=True) for _ in range(n)), key=repr)

    tokenizer = bpe.tokenizer()
    got = P.tokenize(spark, mixed, DATA)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == Counter(
        (r["doc_id"], len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in mixed.collect()
    )


def unique_by_hand(rows):
    """One (doc_id, text) of each group; rows without a word stay."""
    groups = {}
    for k, root in enumerate(roots_by_hand(rows, 80, 5)):
        groups.setdefault(root, []).append(rows[k])
    out = []
    for mine in groups.values():
        least = min((r[0] for r in mine if r[0] is not None), default=None)
        if (mine[0][1] or "").encode().split():
            out.append(next(r for r in mine if r[0] == least))
        else:
            out += mine
    return out


def test_unrelated_rows_of_one_doc_id_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (7, a), (7, b), (8, b + " more"), (9, None), (9, None), (10, "c d"), (10, "c d"), (None, a), (None, "e f g"), (None, "e f g")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r[:2] for r in table(P.drop_near_duplicates(spark, df.withColumn("row_key", F.lit(1)), DATA))]
    assert got == sorted([(1, a), (7, b), (9, None), (9, None), (10, "c d"), (None, "e f g")], key=repr)
    assert got == sorted(unique_by_hand(rows), key=repr)


def test_run_is_registered_and_repeats(spark):
    assert [s[0] for s in P.STAGES] == ["language_id", "jaccard_join", "secret_scan", "mix_sources", "bpe_tokens"]
    first = table(entry.queries()["pipeline"](spark, DATA))
    assert first and first == table(P.run(spark, DATA))


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))


def full_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))


def test_executors_hand_back_heap_before_each_stage(spark):
    """The heap that jaccard_join had grown stayed while bpe_tokens' Python workers took theirs."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    for name, stage in P.STAGES:
        before = full_collections(spark)
        stage(spark, docs, DATA)
        assert full_collections(spark) > before, name


def test_driver_tables_start_no_python_workers(spark):
    """A list given to createDataFrame goes through workers of another kind, which wait beside those of Arrow."""
    assert "ExistingRDD" not in bpe.pieces(spark)._jdf.queryExecution().toString()
    vocabulary = bpe.tokenizer().get_vocab(with_added_tokens=True)
    assert {r["piece"]: r["id"] for r in bpe.pieces(spark).collect()} == vocabulary
