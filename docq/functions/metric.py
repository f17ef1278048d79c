"""Scores of a prediction against a text."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from docq.functions import num
from docq.functions.text import norm_space


def cer(ref: Column, hyp: Column) -> Column:
    """Edit distance over the longer length, 0 to 1; 0 for two empty texts."""
    a, b = norm_space(ref), norm_space(hyp)
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 0.0).otherwise(F.levenshtein(a, b) / most)


def cer_unbounded(ref: Column, hyp: Column) -> Column:
    """Edit distance over the reference's length; may exceed 1."""
    a, b = norm_space(ref), norm_space(hyp)
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(a))


@F.pandas_udf(DoubleType())
def cer_opcode(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Cost of difflib's edit script over the longer length: kept for old figures."""

    def one(a, b):
        a, b = a or "", b or ""
        if a == b:
            return 0.0
        ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        cost = sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in ops if tag != "equal")
        return cost / max(len(a), len(b), 1)

    return pd.Series([one(a, b) for a, b in zip(ref, hyp, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def cer_ratio(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """One less difflib's ratio: kept for old figures."""
    return pd.Series([1 - difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for a, b in zip(ref, hyp, strict=True)], dtype=float)


def similarity(a: Column, b: Column) -> Column:
    """Normalised edit similarity, 1 for two empty texts."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def value_score(pred: Column, gt: Column, tol: float = 1e-4) -> Column:
    """1 or 0 for a numeric gt (within tol), else edit similarity of lower-cased,
    space-collapsed texts; null counts as the text "none"."""
    text = [F.lower(norm_space(F.coalesce(c.cast("string"), F.lit("none")))) for c in (pred, gt)]
    number = [num.as_number(c) for c in (pred, gt)]
    near = F.coalesce(F.abs(number[0] - number[1]) <= tol, F.lit(False)).cast("double")
    return F.when(number[1].isNotNull(), near).otherwise(similarity(*text))


def avg_score(cer_value: Column, teds_value: Column) -> Column:
    """Mean of 1 - CER (not below 0) and TEDS, of those that there are."""
    parts = F.array_compact(F.array(F.greatest(F.lit(0.0), 1 - cer_value) if cer_value is not None else F.lit(None), teds_value))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(parts) > 0, total / F.size(parts))


def signed_gain(task: Column, before: Column, after: Column) -> Column:
    """Positive where it got better: TEDS up for tables, CER down for the rest."""
    return F.when(task == "table", after - before).otherwise(before - after)


@F.pandas_udf(ArrayType(StructType([StructField("tag", StringType()), StructField("gt", StringType()), StructField("pred", StringType())])))
def diff_marks(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """difflib's edit script as (tag, gt, pred) pieces that join to both texts."""

    def one(a, b):
        a, b = a or "", b or ""
        return [{"tag": t, "gt": a[i1:i2], "pred": b[j1:j2]} for t, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()]

    return pd.Series([one(a, b) for a, b in zip(ref, hyp, strict=True)])
