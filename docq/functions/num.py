"""Numbers inside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(c: Column) -> Column:
    """Digits and minus signs of a text as a number; null where that is none."""
    return F.regexp_replace(c.cast("string"), r"[^0-9-]", "").try_cast("bigint")


def to_num(c: Column) -> Column:
    """Number after dropping everything but digits, point and minus, cut to a whole one."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.-]", "").try_cast("double").try_cast("bigint")


def as_number(c: Column) -> Column:
    """The whole text as a number (commas allowed), else null."""
    return F.trim(F.replace(c.cast("string"), F.lit(","), F.lit(""))).try_cast("double")


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def tokens(c: Column) -> Column:
    """Number tokens, commas dropped."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[0-9][0-9,]*"), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")))


def recall(gt: Column, pred: Column) -> Column:
    """Share of the number tokens of gt that pred has; null where gt has none."""
    a = tokens(gt)
    hit = F.filter(a, lambda t: F.array_contains(tokens(pred), t))
    return F.when(F.size(a) > 0, F.size(hit) / F.size(a))


def extra(gt: Column, pred: Column) -> Column:
    """Number tokens of pred that gt lacks."""
    return F.size(F.filter(tokens(pred), lambda t: ~F.array_contains(tokens(gt), t)))
