"""Splits, quotas, mixes and ranked picks.

Shuffles become orders by a seeded hash of the key, so a draw is the same in
every run and on any partitioning.  A global rank counts hash buckets first, so
no window has to hold all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docq.functions.ids import draw, unit


def _rank(df: DataFrame, key: str, seed: int) -> DataFrame:
    """n_ (rows) and rank_ (from 0) of every row by a seeded hash of a unique key."""
    h = df.withColumn("h_", draw(seed, F.col(key).cast("string"))).withColumn("b_", F.substring("h_", 1, 3))
    counts = h.groupBy("b_").agg(F.count("*").alias("c_"))
    # At most 4096 buckets.
    base = counts.select("b_", (F.sum("c_").over(Window.orderBy("b_")) - F.col("c_")).alias("at_"), F.sum("c_").over(Window.partitionBy()).alias("n_"))
    inside = F.row_number().over(Window.partitionBy("b_").orderBy("h_", key)) - 1
    return h.join(F.broadcast(base), "b_").withColumn("rank_", F.col("at_") + inside).drop("h_", "b_", "at_")


def structure_score(text: Column) -> Column:
    """Tables 3, formulas 2, heading levels 2 (one level 1), long text 1."""
    table = text.rlike(r"(?m)^\|.*\|") | F.lower(text).contains("<table")
    formula = text.rlike(r"\$.+?\$|\\\(|\\begin\{(?:equation|align)")
    levels = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6})\s"), F.lit(1))))
    return (
        F.when(table, 3).otherwise(0) + F.when(formula, 2).otherwise(0) + F.when(levels >= 2, 2).when(levels == 1, 1).otherwise(0) + F.when(F.length(text) > 800, 1).otherwise(0)
    )


def topk_structure(df: DataFrame, text: str, doc: str, n: int) -> DataFrame:
    """The n best by structure score; texts of score 0 are left out."""
    return df.withColumn("structure", structure_score(F.col(text))).where("structure > 0").orderBy(F.desc("structure"), doc).limit(n)


def table_complexity(html: Column) -> dict[str, Column]:
    cells, rows = F.regexp_count(html, F.lit("<td")), F.regexp_count(html, F.lit("<tr"))
    span, fmt = F.regexp_count(html, F.lit("(?:row|col)span")), F.regexp_count(html, F.lit(r"<(?:b|i|sup|sub|strong|em)\b"))
    return {"complexity": cells + rows + span * 3 + fmt * 2, "cells": cells, "rows": rows}


def topk_table_complexity(df: DataFrame, html: str, doc: str, n: int, min_cells: int = 12, min_rows: int = 4) -> DataFrame:
    return df.withColumns(table_complexity(F.col(html))).where((F.col("cells") >= min_cells) & (F.col("rows") >= min_rows)).orderBy(F.desc("complexity"), doc).limit(n)


def length_bucket(text: Column) -> Column:
    return F.when(F.length(text) < 200, "short").when(F.length(text) < 800, "mid").otherwise("long")


def bucket_quota(df: DataFrame, text: str, doc: str, n: int, short_ratio: float = 0.05, seed: int = 0) -> DataFrame:
    """n rows: a share of short texts, the rest halved between mid and long; what a
    bucket lacks comes from the others' leftovers, long first."""
    short = int(n * short_ratio)
    want = {"short": short, "mid": (n - short) // 2, "long": n - short - (n - short) // 2}
    quota, turn = F.lit(0), F.lit(0)
    for i, k in enumerate(("long", "mid", "short")):
        quota = F.when(F.col("bucket") == k, want[k]).otherwise(quota)
        turn = F.when(F.col("bucket") == k, i).otherwise(turn)
    d = df.withColumn("bucket", length_bucket(F.col(text))).withColumn("h_", draw(seed, F.col(doc).cast("string")))
    # No more than n of a bucket can be taken, so the second order has 3 n rows at most.
    d = d.withColumn("r_", F.row_number().over(Window.partitionBy("bucket").orderBy("h_", doc))).where(F.col("r_") <= n)
    d = d.withColumn("late_", (F.col("r_") > quota).cast("int")).withColumn("turn_", turn)
    return d.orderBy("late_", "turn_", "r_").limit(n).drop("h_", "r_", "late_", "turn_")


def cap_per_group(df: DataFrame, group: str, doc: str, cap: int, seed: int = 0) -> DataFrame:
    w = Window.partitionBy(group).orderBy(draw(seed, F.col(doc).cast("string")), doc)
    return df.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= cap).drop("r_")


k_per_group = cap_per_group


def stratified_split(df: DataFrame, stratum: str, doc: str, ratios: tuple[float, float] = (0.8, 0.1), seed: int = 0) -> DataFrame:
    """split: of each stratum in drawn order, int(n r) train, int(n r) val, the rest test."""
    h = df.withColumn("g_", F.struct(stratum)).withColumn("h_", draw(seed, F.col(doc).cast("string"))).withColumn("b_", F.substring("h_", 1, 3))
    counts = h.groupBy("g_", "b_").agg(F.count("*").alias("c_"))
    upto = F.sum("c_").over(Window.partitionBy("g_").orderBy("b_")) - F.col("c_")
    base = counts.select("g_", "b_", upto.alias("at_"), F.sum("c_").over(Window.partitionBy("g_")).alias("n_"))
    # A stratum is ranked in up to 4096 buckets of the hash; rows move once, for the join and the window.
    d = h.join(base, ["g_", "b_"]).withColumn("r_", F.col("at_") + F.row_number().over(Window.partitionBy("g_", "b_").orderBy("h_", doc)))
    train, val = (F.floor(F.round(F.col("n_") * r, 9)) for r in ratios)
    split = F.when(F.col("r_") <= train, "train").when(F.col("r_") <= train + val, "val").otherwise("test")
    return d.select(*[F.col(f"`{c}`") for c in df.columns if c != "split"], split.alias("split"))


def group_split(df: DataFrame, group: str, test: float = 0.1, val: float = 0.1, seed: int = 0) -> DataFrame:
    """split by whole groups: shares of the drawn groups, at least one each."""
    g = _rank(df.select(group).distinct(), group, seed)
    n_test, n_val = (F.greatest(F.lit(1), F.floor(F.round(F.col("n_") * r, 9))) for r in (test, val))
    split = F.when(F.col("rank_") < n_test, "test").when(F.col("rank_") < n_test + n_val, "val").otherwise("train")
    return df.join(g.select(group, split.alias("split")), group)


def hash_split(df: DataFrame, doc: str, ratios: tuple[float, float] = (0.8, 0.1), seed: int = 0) -> DataFrame:
    """split by where the id's hash falls: needs no counts and never changes."""
    u = unit(F.lit(str(seed)), F.col(doc).cast("string"))
    return df.withColumn("split", F.when(u < ratios[0], "train").when(u < ratios[0] + ratios[1], "val").otherwise("test"))


def random_split(df: DataFrame, doc: str, val_ratio: float, min_val: int, seed: int = 0) -> DataFrame:
    """split: max(min_val, int(n val_ratio)) drawn rows are val."""
    d = _rank(df, doc, seed)
    n_val = F.greatest(F.lit(min_val), F.floor(F.round(F.col("n_") * val_ratio, 9)))
    return d.withColumn("split", F.when(F.col("rank_") < n_val, "val").otherwise("train")).drop("rank_", "n_")


def oversample(df: DataFrame, repeat: int) -> DataFrame:
    """Every row `repeat` times, numbered."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeat))))


def balance(df: DataFrame, is_hard: str, doc: str, ratio: float = 0.35, seed: int = 0) -> DataFrame:
    """All hard rows, and drawn clean ones so that hard ones make up `ratio`:
    hard (1 - r) / r clean rows, between half of them and all."""
    hard = df.where(F.col(is_hard))
    clean = _rank(df.where(~F.col(is_hard)), doc, seed)
    want = hard.agg(F.floor(F.round(F.count("*") * (1 - ratio) / ratio, 9)).alias("w_"))
    keep = F.least(F.col("n_"), F.greatest(F.floor(F.col("n_") / 2), F.col("w_")))
    picked = clean.crossJoin(F.broadcast(want)).where(F.col("rank_") < keep).drop("rank_", "n_", "w_")  # one row
    return hard.unionByName(picked)


def fill_to_target(current: DataFrame, candidates: DataFrame, doc: str, target: int, seed: int = 0) -> DataFrame:
    """Drawn candidates that current lacks, as many as it needs to reach target."""
    need = max(0, target - current.count())
    return candidates.join(current.select(doc), doc, "left_anti").orderBy(draw(seed, F.col(doc).cast("string")), doc).limit(need)


def limit_per(df: DataFrame, key: str, n: int, order: list[str]) -> DataFrame:
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r_") <= n).drop("r_")


def worklist(df: DataFrame, text: str, min_score: float = 20) -> DataFrame:
    """score (0 to 100) and reasons of texts that need correction, for those at min_score or more."""
    from docq.operators.rules import empty_share, table_cells

    c = F.col(text)
    cells, share = F.size(table_cells(c)), F.coalesce(empty_share(c), F.lit(0.0))
    share = F.when(cells >= 6, share).otherwise(0.0)
    money = F.regexp_count(c, F.lit(r"[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+원"))
    no_date = ~c.rlike(r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}")
    score = share * 60 + F.when(money == 0, 25).when(money < 3, 10).otherwise(0) + F.when(no_date, 8).otherwise(0) + F.when(F.length(c) < 200, 12).otherwise(0)
    reasons = F.array_compact(
        F.array(F.when(share > 0.5, "empty_cells"), F.when(money == 0, "no_money").when(money < 3, "little_money"), F.when(no_date, "no_date"), F.when(F.length(c) < 200, "short"))
    )
    return df.withColumns({"score": F.least(F.lit(100.0), score), "reasons": reasons}).where(F.col("score") >= min_score)


def bottom_n(df: DataFrame, metric: str, tie: str, n: int, threshold: float = 0.70) -> DataFrame:
    return df.where(F.col(metric) < threshold).orderBy(metric, tie).limit(n)


def threshold_sweep(df: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """threshold, kept, dropped, all in one pass."""
    each = df.agg(*[F.count_if(F.col(score) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)], F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("kept"), (F.col("n") - F.col(f"t{i}")).alias("dropped")) for i, t in enumerate(thresholds)])
    return each.select(F.inline(rows))


def id_range(df: DataFrame, doc: str, prefix: str, upto: str) -> DataFrame:
    return df.where(F.col(doc).startswith(prefix) & (F.col(doc) <= upto))


def systematic(df: DataFrame, order: str, sample: int, seed: int = 0) -> DataFrame:
    """Every step-th row of a drawn order of a unique column, step = n // sample (1 at least)."""
    d = _rank(df, order, seed)
    step = F.greatest(F.lit(1), F.floor(F.col("n_") / sample))
    return d.where(F.col("rank_") % step == 0).drop("rank_", "n_")
