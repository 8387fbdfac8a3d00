"""Places of regular-expression matches, in DataFrame functions only.

Java's ``split`` and ``regexp_extract_all`` walk the same leftmost, non-overlapping matches, so the
pieces between matches and the matches themselves give every match's code-point offsets. Offsets are
running sums, made in chunks of ``CHUNK`` values, since an array that grows by one value at a time is
copied each time: time grows with a text's length (and a 1/CHUNK part of its square in matches).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered by their first fields: start, then rank (the order of the kinds).
SPAN = "struct<start:int,rank:int,end:int,kind:string,match:string,left:string,right:string>"
NONE = f"cast(array() as array<{SPAN}>)"
CHUNK = 256
_SPACE, _BLACK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: The last whole word before the one that a match begins in, the first after the one it ends in.
LAST_WORD = rf"(?<!{_BLACK})({_BLACK}++){_SPACE}++{_BLACK}*+\z"
NEXT_WORD = rf"^{_BLACK}*+{_SPACE}++({_BLACK}++)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """Of an array<int>: for each value, ``op`` over ``zero`` and all values before it."""

    def grown(some: Column, first: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(some, F.array(first), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), of(x)))))

    def cut(every: Column) -> Column:
        count = F.floor(F.greatest(F.size(every) - 1, F.lit(0)) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda k: F.slice(every, k * CHUNK + 1, F.lit(CHUNK)))

    def placed(parts: Column) -> Column:
        heads = grown(parts, F.lit(zero), lambda part: F.aggregate(part, F.lit(zero), lambda a, b: op(a, b)))
        return let(
            heads,
            lambda bases: F.flatten(
                F.transform(parts, lambda part, k: F.slice(grown(part, F.get(bases, k), lambda x: x), F.lit(1), F.size(part)))
            ),
        )

    return let(let(values, cut), placed)


def whole(match: Column) -> tuple[Column, Column]:
    """The matched string as the span's own: nothing cut off its front."""
    return F.lit(0), match


def found(text: Column, kind: str, rank: int, pattern: str, maybe: Column, keep, words: bool = False, core=whole) -> Column:
    """Spans of ``pattern`` (no capture groups) in ``text`` whose matched string passes ``keep``.

    ``core`` gives how much is cut off a match's front, and what is left of it. With ``words`` each span
    has its left and right word, in lower case, looked for as far as the match before the one before
    and after the one after. ``maybe`` is a cheap necessary condition: the pattern runs on no text that
    fails it.
    """
    gaps = F.split(text, pattern, -1).alias("gap")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")

    def walked(parts: Column) -> Column:
        sizes = F.transform(parts, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0)))
        some = lambda i, field: F.coalesce(F.get(parts, i)[field], F.lit(""))

        def span(x: Column, i: Column, at: Column) -> Column:
            lead, mine = core(F.coalesce(x["match"], F.lit("")))
            start = F.get(at, i) + F.length(x["gap"]) + lead
            before = F.concat(some(i - 1, "gap"), some(i - 1, "match"), x["gap"])
            after = F.concat(some(i + 1, "gap"), some(i + 1, "match"), some(i + 2, "gap"))
            return F.struct(
                start.alias("start"),
                F.lit(rank).alias("rank"),
                (start + F.length(mine)).alias("end"),
                F.lit(kind).alias("kind"),
                mine.alias("match"),
                (F.lower(F.regexp_extract(before, LAST_WORD, 1)) if words else F.lit("")).alias("left"),
                (F.lower(F.regexp_extract(after, NEXT_WORD, 1)) if words else F.lit("")).alias("right"),
            )

        spans = lambda at: F.filter(
            F.transform(parts, lambda x, i: F.when(x["match"].isNotNull() & keep(F.coalesce(x["match"], F.lit(""))), span(x, i, at))),
            lambda s: s.isNotNull(),
        )
        return let(running(sizes, 0, lambda a, b: a + b), spans)

    return F.when(maybe, let(F.arrays_zip(gaps, matches), walked)).otherwise(F.expr(NONE))


def in_order(spans: Column) -> Column:
    """By start, then rank (the order of the kinds)."""
    return F.array_sort(spans)


def listed_in_order(spans: Column) -> Column:
    """kind:start:end by start, then rank, comma-joined."""
    return F.array_join(
        F.transform(
            in_order(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def runs(spans: Column) -> Column:
    """Maximal runs of covered characters: array of (start, end) in order; runs that touch are one."""

    def merged(some: Column) -> Column:
        ends = F.transform(some, lambda s: s["end"])
        furthest = F.array_max(ends)

        def cut(reach: Column) -> Column:
            fresh = F.filter(F.transform(some, lambda s, i: F.when(s["start"] > F.get(reach, i), F.struct(s["start"].alias("start"), i.alias("i")))), lambda x: x.isNotNull())
            return let(
                F.struct(fresh.alias("heads"), furthest.alias("top")),
                lambda p: F.transform(
                    p["heads"],
                    lambda x, k: F.struct(
                        x["start"].alias("start"),
                        # The furthest end before the next run begins, or of all.
                        F.coalesce(F.get(reach, F.get(p["heads"], k + 1)["i"]), p["top"]).alias("end"),
                    ),
                ),
            )

        return let(running(ends, -1, F.greatest), cut)

    return let(in_order(spans), merged)


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every maximal run of covered characters replaced by ``mark``.

    The text is cut once for every CHUNK runs, and these within their part of it.
    """

    def replaced(covers: Column) -> Column:
        count = F.floor((F.size(covers) - 1) / CHUNK).cast("int")

        def part(k: Column) -> Column:
            first = F.when(k == 0, F.lit(0)).otherwise(F.get(covers, k * CHUNK - 1)["end"])
            last = F.when(k == count, F.length(text)).otherwise(F.get(covers, k * CHUNK + CHUNK - 1)["end"])
            mine = F.slice(covers, k * CHUNK + 1, F.lit(CHUNK))

            def pieces(body: Column) -> Column:
                return let(
                    mine,
                    lambda some: F.concat(
                        F.array_join(
                            F.transform(
                                some,
                                lambda s, i: F.concat(
                                    F.substring(
                                        body,
                                        F.coalesce(F.get(some, i - 1)["end"], first) - first + 1,
                                        s["start"] - F.coalesce(F.get(some, i - 1)["end"], first),
                                    ),
                                    F.lit(mark),
                                ),
                            ),
                            "",
                        ),
                        F.substring(body, F.element_at(some, -1)["end"] - first + 1, F.length(body)),
                    ),
                )

            return let(F.substring(text, first + 1, last - first), pieces)

        return F.array_join(F.transform(F.sequence(F.lit(0), count), part), "")

    return F.when(F.size(spans) > 0, let(runs(spans), replaced)).otherwise(text)
