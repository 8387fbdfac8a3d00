"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns up to it, rendered with a chat
template, and a loss mask over that reply's text alone. Turns after the last reply give one more
example with an empty mask, so no turn is lost.

Template, per turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Inside roles and texts
``%`` is written ``%25`` and ``<|`` is written ``%3C|`` (a newline in a role ``%0A``), so a text can't
close or open a turn; ``unescape`` restores every string exactly.

Defined results: a null role or text is an empty one; turns are ordered by turn (null first), equal
turns by role, then text; repeated rows stay as turns of their own; rows with a null conv_id form one
conversation; a conversation without a reply gives one example with an empty mask; an empty table
gives no rows; other columns are ignored. Text cells may be of any length a Spark string can have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streammart.llm.common import table

NAME = "op1_chat_prefix_target"
START, END = "<|im_start|>", "<|im_end|>"
PROBE = "<|im_end|><|im_start|>assistant ok"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("%0A"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("%0A"), F.lit("\n")))


def prefix_target_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per example.

    conv_id, example (from 0), formatted, loss_start (code points before the target), loss_chars,
    last (whether it holds the whole conversation).
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    conversations = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape_role(t.role), F.lit("\n"))
    rendered = conversations.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t.role == "assistant").alias("target"),
                head(t).alias("head"),
                escape(t.text).alias("body"),
            ),
        ).alias("turns"),
    )
    # Of each turn: where its text begins and where the turn ends in the whole conversation.
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END + "\n"))), "")
    tail = len(END) + 1
    places = F.aggregate(
        "turns",
        F.struct(
            F.lit(0).alias("end"),
            F.expr("cast(array() as array<struct<start:int,size:int,end:int>>)").alias("targets"),
        ),
        lambda acc, t: F.struct(
            (acc.end + F.length(t.head) + F.length(t.body) + tail).alias("end"),
            F.when(
                t.target,
                F.concat(
                    acc.targets,
                    F.array(
                        F.struct(
                            (acc.end + F.length(t.head)).alias("start"),
                            F.length(t.body).alias("size"),
                            (acc.end + F.length(t.head) + F.length(t.body) + tail).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc.targets)
            .alias("targets"),
        ),
    )
    placed = rendered.select("conv_id", whole.alias("whole"), places.alias("p"))
    none = F.struct(F.col("p.end").alias("start"), F.lit(0).alias("size"), F.col("p.end").alias("end"))
    closed = F.size("p.targets") > 0
    covered = F.when(closed, F.element_at("p.targets", -1).end).otherwise(F.lit(-1)) == F.col("p.end")
    targets = F.when(covered, F.col("p.targets")).otherwise(F.concat("p.targets", F.array(none)))
    return placed.select(
        "conv_id", "whole", F.col("p.end").alias("whole_chars"), F.posexplode(targets).alias("example", "t")
    ).select(
        "conv_id",
        "example",
        F.expr("substring(whole, 1, t.end)").alias("formatted"),
        F.col("t.start").alias("loss_start"),
        F.col("t.size").alias("loss_chars"),
        (F.col("t.end") == F.col("whole_chars")).alias("last"),
    )


def read_turns(formatted: Column) -> Column:
    """Parses a formatted example back into an array of (role, text)."""
    parts = F.filter(F.split(formatted, START.replace("|", "[|]"), -1), lambda p, i: i > 0)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(
                F.substring(
                    p,
                    F.length(F.substring_index(p, "\n", 1)) + 2,
                    F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - (len(END) + 1),
                )
            ).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """What the examples say of each conversation, read back from their formatted text and masks."""
    target = unescape(F.expr("substring(formatted, loss_start + 1, loss_chars)"))
    turns = read_turns(F.col("formatted"))
    read = examples.select(
        "conv_id",
        F.struct("example", target.alias("text")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
        F.when(
            F.col("last"),
            F.struct(
                F.size(turns).cast("long").alias("n"),
                F.sha2(
                    F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""),
                    256,
                ).alias("sha"),
            ),
        ).alias("whole"),
    )
    grouped = read.groupBy("conv_id").agg(
        F.max("whole").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x.text), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return grouped.select(
        "conv_id",
        F.col("whole.n").alias("n_turns"),
        F.col("whole.sha").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return digests(prefix_target_examples(turns.unionByName(probe)))


SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), r AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(12 + length(replace(replace(replace(role, '%', '%25'), '<|', '%3C|'), chr(10), '%0A')) + 1
        + length(replace(replace(text, '%', '%25'), '<|', '%3C|')) + 11)
      OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR rn = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
