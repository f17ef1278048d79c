"""Spans of regular-expression matches, with built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,text:string>>"


#: Matches that are folded one by one; arrays grow by no more at a time.
CHUNK = 128
#: Bytes up to which a text's matches are folded as one chunk.
SHORT = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_spans(text: Column, pattern: str, ok: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, end, text), in code points,
    end exclusive; `ok` keeps a match.

    The text between matches (split) and the matches themselves give every
    position as a running length, so nothing is searched for a second time.
    Running lengths are added up by chunks of CHUNK matches, then inside each, as an array that grows by
    one is copied each time: time goes with the matches, not with their square.
    A text without a match, or null, costs one search and gives an empty array.
    The pattern must not match the empty string.
    """
    empty = F.expr(f"cast(array() as {SPAN})")
    zero = F.lit(0).cast("bigint")
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def size(x: Column) -> Column:
        return F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        keep = x["m"].isNotNull() if ok is None else x["m"].isNotNull() & ok(x["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text")))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def folded(some: Column, at: Column) -> Column:
        return F.aggregate(some, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def chunked(all_: Column) -> Column:
        def chunk(c: Column) -> Column:
            return F.slice(all_, c * CHUNK + 1, F.lit(CHUNK))

        numbers = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int"))
        sums = F.transform(numbers, lambda c: F.aggregate(chunk(c), zero, lambda n, x: n + size(x)))
        heads = F.aggregate(
            sums, F.struct(zero.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out")),
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"],
        )
        return F.flatten(F.transform(heads, lambda head, c: folded(chunk(c), head)))

    # A short text has few matches, and its parts need no name.
    short = F.octet_length(text) <= SHORT
    return F.when(text.rlike(pattern), F.when(short, folded(parts, zero)).otherwise(_let(parts, chunked))).otherwise(empty)


def merged(spans: Column, touching: bool = True) -> Column:
    """The union of spans in any order, as disjoint (start, end) in order; spans that
    only touch become one where `touching` says so.

    With starts and ends each sorted by itself, a new part begins where all spans
    that began earlier have ended, which is where the end of one place less lies
    before the start.  Nothing grows span by span.
    """

    def parts(at: Column) -> Column:
        starts, ends = at["starts"], at["ends"]

        def apart(end: Column, start: Column) -> Column:
            return end < start if touching else end <= start

        first = F.filter(starts, lambda s, i: (i == 0) | apart(F.get(ends, i - 1), s))
        last = F.filter(ends, lambda e, i: (i == F.size(ends) - 1) | apart(e, F.get(starts, i + 1)))
        return F.arrays_zip(first.alias("start"), last.alias("end")).cast("array<struct<start:bigint,end:bigint>>")

    starts = F.array_sort(F.transform(spans, lambda s: s["start"]))
    ends = F.array_sort(F.transform(spans, lambda s: s["end"]))
    return _let(F.struct(starts.alias("starts"), ends.alias("ends")), parts)


def marked(text: Column, spans: Column, mark: str) -> Column:
    """text with each of disjoint, ordered, non-empty list `spans` replaced by mark.

    What stays is cut out of stretches of CHUNK spans, not each time out of the
    whole text, whose code points are counted from its beginning.
    """

    def joined(held: Column) -> Column:
        def from_(i: Column) -> Column:
            return F.coalesce(F.get(held, i - 1)["end"], F.lit(0).cast("bigint"))

        def cut(body: Column, at: Column, size: Column) -> Column:
            return F.substring(body, (at + 1).cast("int"), size.cast("int"))

        def stretch(c: Column) -> Column:
            some = F.slice(held, c * CHUNK + 1, F.lit(CHUNK))
            at = from_(c * CHUNK)
            body = cut(text, at, F.element_at(some, -1)["end"] - at)

            def kept(b: Column) -> Column:
                pieces = F.transform(some, lambda s, i: F.concat(cut(b["body"], from_(c * CHUNK + i) - b["at"], s["start"] - from_(c * CHUNK + i)), F.lit(mark)))
                return F.array_join(pieces, "")

            return _let(F.struct(at.alias("at"), body.alias("body")), kept)

        numbers = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / CHUNK).cast("int"))
        rest = cut(text, F.element_at(held, -1)["end"], F.length(text))
        return F.concat(F.array_join(F.transform(numbers, stretch), ""), rest)

    return _let(spans, joined)


def of_kind(kind: str, order: int, spans: Column) -> Column:
    """The spans as (start, rank, end, kind), ready to be sorted by start, then kind."""
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )


def written(spans: Column) -> Column:
    """kind:start:end of each span in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
