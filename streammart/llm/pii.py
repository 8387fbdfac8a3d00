"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame functions only.

The base kinds (e-mail, IPv4 address, payment card, phone) give the seed entities: every base span is an
instance, white space included. So is every other token that looks like an identifier (CANDIDATE). Lexical patterns
are the whole word to an instance's left, or to its right, with the instance's shape (letter runs ``a``,
digit runs ``9``, a lone run with its length). Patterns and instances form a graph, scored in rounds: a pattern's
confidence is the share of its distinct instances that are trusted; an instance is trusted if it is a
seed or some accepted pattern holds it. Patterns need ``MIN_SEEDS`` distinct trusted instances and a
confidence of ``MIN_CONFIDENCE``, so that one may hold as many unseen instances as known ones. Rounds
go on until no new pattern is accepted; acceptance only grows, so they end. What accepted patterns hold
beyond the base spans is added as kind ``ctx``.

Defined results: a null text has no span; repeated rows and rows with equal or null doc_id are rows of
their own; an empty table gives no rows; other columns are ignored; ill-formed UTF-8 is read as Java
reads it; an instance at a text's start or end has no left or right pattern. Counts cover all documents,
and instances are of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streammart.llm import spans as S
from streammart.llm.common import spread, staged, table

NAME = "op10_pii_bootstrap"
MIN_SEEDS, MIN_CONFIDENCE = 3, 0.5

# The patterns of the base kinds (possessive, anchored to where a match can begin).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:[.]|$)){4}$"
# Candidate instances (CANDIDATE): tokens without the marks around them that hold @, or MIN_DIGITS digits
# among MIN_CHARS characters or more.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
MIN_DIGITS, MIN_CHARS = 4, 7
FRONT, BACK = r"^[^\p{L}\p{N}+]+", r"[^\p{L}\p{N}]+\z"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digit string passes the Luhn check."""
    n = F.length(number)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when((n - i) % 2 == 0, F.substring(number, i, F.lit(1)).cast("int")).otherwise(
            F.substring(number, i, F.lit(1)).cast("int") * 2
            - F.when(F.substring(number, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def is_card(m: Column) -> Column:
    return F.when(F.length(digits(m)).between(14, 19), luhn(digits(m))).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    numeric = text.rlike("[0-9]")
    return F.concat(
        S.found(text, "email", 0, EMAIL, F.contains(text, F.lit("@")), lambda m: F.length(m) > 0, True),
        S.found(text, "ip", 1, IP, numeric & text.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(IP_PARTS), True),
        S.found(text, "card", 2, CARD, numeric, is_card, True),
        S.found(
            text, "phone", 3, PHONE, F.contains(text, F.lit("+")), lambda m: F.length(digits(m)).between(10, 15), True
        ),
    )


def core(match: Column) -> tuple[Column, Column]:
    """How many marks stand before a token, and the token without the marks around it."""
    mine = F.regexp_replace(match, FRONT, "")
    return F.length(match) - F.length(mine), F.regexp_replace(mine, BACK, "")


def is_candidate(match: Column) -> Column:
    mine = core(match)[1]
    return F.contains(mine, F.lit("@")) | ((F.length(mine) >= MIN_CHARS) & (F.length(digits(mine)) >= MIN_DIGITS))


def candidate_spans(text: Column) -> Column:
    return S.found(text, "ctx", 4, TOKEN, text.rlike("[0-9@]"), is_candidate, True, core)


def scan(docs: DataFrame) -> DataFrame:
    """rid, doc_id, base, candidates (those that meet no base span): what the texts hold; no text is kept."""
    text = F.coalesce("text", F.lit(""))
    every = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", S.in_order(base_spans(text)).alias("base"), candidate_spans(text).alias("some")
    )

    last = (1 << 31) - 1

    def apart(spans: Column) -> Column:
        """Of all spans in order, candidates that no base span before reaches into and none after begins in."""
        ends = F.transform(spans, lambda s: F.when(s["rank"] < 4, s["end"]).otherwise(F.lit(-1)))
        starts = F.reverse(F.transform(spans, lambda s: F.when(s["rank"] < 4, s["start"]).otherwise(F.lit(last))))
        reach, following = S.running(ends, -1, lambda a, b: F.greatest(a, b)), F.reverse(S.running(starts, last, lambda a, b: F.least(a, b)))
        free = lambda s, i, p: F.when((s["rank"] == 4) & (F.get(p["r"], i) <= s["start"]) & (F.get(p["f"], i) >= s["end"]), s)
        return S.let(
            F.struct(reach.alias("r"), following.alias("f")),
            lambda p: F.filter(F.transform(spans, lambda s, i: free(s, i, p)), lambda s: s.isNotNull()),
        )

    candidates = S.let(S.in_order(F.concat("base", "some")), apart)
    return every.select("rid", "doc_id", "base", F.when(F.size("some") > 0, candidates).otherwise(F.expr(S.NONE)).alias("candidates"))


def edges_of(scanned: DataFrame) -> DataFrame:
    """Distinct (side, word, shape, instance, seed): the graph between patterns and instances."""
    one = scanned.select(F.explode(F.concat("base", "candidates")).alias("c"))
    return patterns_of(one).select("side", "word", "shape", F.md5("c.match").alias("instance"), (F.col("c.rank") < 4).alias("seed")).groupBy(
        "side", "word", "shape", "instance"
    ).agg(F.max("seed").alias("seed"))


def patterns_of(one: DataFrame) -> DataFrame:
    """(.., c) -> its columns with side, word and shape of each pattern that holds the span."""
    flat = F.regexp_replace(F.regexp_replace("c.match", r"\p{L}+", "a"), "[0-9]+", "9")
    shape = F.when(flat == "9", F.concat(F.lit("9/"), F.length("c.match").cast("string"))).otherwise(flat)
    sides = F.array(F.struct(F.lit("l").alias("side"), F.col("c.left").alias("word")), F.struct(F.lit("r").alias("side"), F.col("c.right").alias("word")))
    named = one.select("*", shape.alias("shape"), F.explode(sides).alias("p"))
    return named.select("*", "p.side", "p.word").drop("p").filter("word != ''")


def accepted_patterns(edges: DataFrame) -> DataFrame:
    """side, word, shape of the patterns accepted when no round accepts another."""
    key = ["side", "word", "shape"]
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    trusted = staged(seeds.filter("seed").select("instance"), "trusted")
    before = -1
    while True:
        known = edges.join(trusted.withColumn("trusted", F.lit(1)), "instance", "left")
        patterns = staged(
            known.groupBy(*key)
            .agg(F.sum(F.coalesce("trusted", F.lit(0))).alias("known"), F.count("*").alias("all"))
            .filter((F.col("known") >= MIN_SEEDS) & (F.col("known") >= MIN_CONFIDENCE * F.col("all")))
            .select(*key),
            "patterns",
        )
        now = patterns.count()
        if now == before:
            return patterns
        before = now
        held = spread(edges, patterns, key, ["instance"]).select("instance")
        trusted = staged(held.unionByName(edges.filter("seed").select("instance")).distinct(), "trusted")


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, base, more: arrays of spans."""
    scanned = staged(scan(docs), "pii")
    accepted = accepted_patterns(staged(edges_of(scanned), "edges"))
    places = patterns_of(scanned.select("rid", F.explode("candidates").alias("c")))
    new = (
        spread(places.select("rid", "c", "side", "word", "shape"), accepted, ["side", "word", "shape"], ["rid"])
        .groupBy("rid")
        .agg(F.collect_set("c").alias("more"))
    )
    return (
        scanned.select("rid", "doc_id", "base")
        .join(new, "rid", "left")
        .select("doc_id", "base", F.coalesce("more", F.expr(S.NONE)).alias("more"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        *[S.counted(F.col("base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(S.listed_in_order(F.col("base")), 256).alias("base_sha256"),
        S.listed_in_order(F.concat("base", "more")).alias("spans"),
    )


def _sql_kind(rank: int, kind: str, pattern: str, keep: str) -> str:
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, s AS a, s + length(m) AS b, m, g FROM (
    SELECT rid, m, g, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m) AS s FROM (
      SELECT rid, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (
        SELECT rid, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gs FROM t)))
  WHERE {keep}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_SUM = f"""list_sum(list_transform(range(length({_DIGITS})), lambda i:
  CASE WHEN i % 2 = 0 THEN CAST(reverse({_DIGITS})[i + 1] AS INT)
  ELSE 2 * CAST(reverse({_DIGITS})[i + 1] AS INT) - CASE WHEN CAST(reverse({_DIGITS})[i + 1] AS INT) > 4 THEN 9 ELSE 0 END END))"""
SQL_ROUNDS = 8  # more than the test tables need until no pattern is new
_ROUNDS = "".join(
    f""",
p{r} AS (SELECT z, w, h FROM edges JOIN t{r} USING (m) GROUP BY z, w, h
  HAVING sum(CAST(ok AS INT)) >= {MIN_SEEDS} AND sum(CAST(ok AS INT)) >= {MIN_CONFIDENCE} * count(*)),
t{r + 1} AS (SELECT m, bool_or(edges.seed OR p{r}.w IS NOT NULL) AS ok FROM edges LEFT JOIN p{r} USING (z, w, h) GROUP BY m)"""
    for r in range(SQL_ROUNDS)
)
_FRONT, _BACK = "^[^\\p{L}\\p{N}+]+", "[^\\p{L}\\p{N}]+$"
_CORE = f"regexp_replace(regexp_replace(m, '{_FRONT}', ''), '{_BACK}', '')"
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  {_sql_kind(0, "email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")}
  UNION ALL {_sql_kind(1, "ip", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", f"regexp_matches(m, '{IP_PARTS}')")}
  UNION ALL {_sql_kind(2, "card", "[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_SUM} % 10 = 0")}
  UNION ALL {_sql_kind(3, "phone", "[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15")}
), tokens AS (
  {_sql_kind(4, "ctx", "[^ \\t-\\r]*[0-9@][^ \\t-\\r]*", "true")}
), cored AS (
  SELECT rid, a + length(m) - length(regexp_replace(m, '{_FRONT}', '')) AS a, {_CORE} AS m FROM tokens
), spans AS (
  SELECT rid, rank, kind, a, b, m FROM base
  UNION ALL SELECT rid, 4, 'ctx', a, a + length(m), m FROM cored
    WHERE (contains(m, '@') OR length(m) >= {MIN_CHARS} AND length({_DIGITS}) >= {MIN_DIGITS})
      AND NOT EXISTS (FROM base WHERE base.rid = cored.rid AND base.a < cored.a + length(cored.m) AND base.b > cored.a)
), words AS (
  SELECT spans.*, lower(regexp_extract(text[:a], '(?:^|[ \\t-\\r])([^ \\t-\\r]+)[ \\t-\\r]+[^ \\t-\\r]*$', 1)) AS l,
    lower(regexp_extract(text[b + 1:], '^[^ \\t-\\r]*[ \\t-\\r]+([^ \\t-\\r]+)', 1)) AS r,
    regexp_replace(regexp_replace(m, '\\p{{L}}+', 'a', 'g'), '[0-9]+', '9', 'g') AS flat
  FROM spans JOIN t USING (rid)
), places AS (
  SELECT rid, rank, a, b, m, z, w, CASE WHEN flat = '9' THEN '9/' || length(m) ELSE flat END AS h
  FROM (SELECT *, 'l' AS z, l AS w FROM words UNION ALL SELECT *, 'r', r FROM words) WHERE w != ''
), edges AS (SELECT z, w, h, m, bool_or(rank < 4) AS seed FROM places GROUP BY ALL),
t0 AS (SELECT m, bool_or(seed) AS ok FROM edges GROUP BY m){_ROUNDS},
f AS (
  SELECT rid, rank, kind, a, b FROM base
  UNION ALL SELECT DISTINCT rid, 4, 'ctx', a, b FROM places SEMI JOIN p{SQL_ROUNDS - 1} USING (z, w, h) WHERE rank = 4
)
SELECT doc_id, count(f.rid) FILTER (WHERE rank = 0) AS n_email, count(f.rid) FILTER (WHERE rank = 1) AS n_ip,
  count(f.rid) FILTER (WHERE rank = 2) AS n_card, count(f.rid) FILTER (WHERE rank = 3) AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (WHERE rank < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank), '') AS spans
FROM t LEFT JOIN f USING (rid) GROUP BY rid, doc_id
"""
