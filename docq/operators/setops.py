"""Unions, dedup, corrections, reviews and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_tagged(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Rows of all frames with the name of theirs; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(n)) for n, df in frames.items()])


def merge_eval(val: DataFrame, test: DataFrame) -> DataFrame:
    return val.unionByName(test)


def leakage(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Groups on both sides; a clean split has none."""
    return a.select(group).intersect(b.select(group))


def accumulate(current: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Names of `new` that are not yet listed, once each."""
    return new.select(name).distinct().join(current, name, "left_anti")


def dedup_first(df: DataFrame, fingerprint: str, order: str) -> DataFrame:
    """The first row of each fingerprint with the number of its copies."""
    first = df.groupBy(fingerprint).agg(F.min(order).alias(order), (F.count("*") - 1).alias("copies"))
    return df.join(first, [fingerprint, order])


def drop_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids, on, "left_anti")


def scoped_fix(df: DataFrame, corrections: DataFrame, doc: str, answer: str) -> DataFrame:
    """The answer with old replaced by new in the named documents only, and hits
    (occurrences replaced).  corrections: doc, old, new, one for each document."""
    j = df.join(corrections, doc, "left")
    n = F.when(F.col("old").isNull() | (F.col("old") == ""), 0).otherwise((F.length(answer) - F.length(F.replace(F.col(answer), F.col("old"), F.lit("")))) / F.length("old"))
    fixed = F.when(F.col("old").isNull(), F.col(answer)).otherwise(F.replace(F.col(answer), F.col("old"), F.col("new")))
    return j.withColumn("hits", n.cast("int")).withColumn(answer, fixed).drop("old", "new")


def cell_fix(df: DataFrame, html: str, fixes: dict[str, str]) -> DataFrame:
    """Whole cells of a table replaced, and hits; a fixed list of corrections."""
    c, hits = F.col(html), F.lit(0)
    for wrong, right in fixes.items():
        w = f">{wrong}<"
        hits = hits + ((F.length(c) - F.length(F.replace(c, F.lit(w), F.lit("")))) / len(w)).cast("int")
        c = F.replace(c, F.lit(w), F.lit(f">{right}<"))
    return df.withColumn("hits", hits).withColumn(html, c)


def review_blocks(blocks: DataFrame, actions: DataFrame, doc: str) -> DataFrame:
    """Blocks after a review: keep, edit (text), remove; an action on an unknown
    block adds it.  Numbered anew by (y, x).

    blocks: doc, idx, y, x, text.  actions: doc, idx, action, new_text, new_y, new_x.
    """
    j = blocks.join(actions, [doc, "idx"], "full_outer")
    known = F.col("text").isNotNull() | F.col("y").isNotNull()
    kept = j.where(~(known & F.col("action").eqNullSafe("remove")) & (known | (F.col("action") != "remove")))
    out = kept.select(
        doc, "idx", F.coalesce("y", "new_y").alias("y"), F.coalesce("x", "new_x").alias("x"),
        F.when(~known | (F.col("action") == "edit"), F.col("new_text")).otherwise(F.col("text")).alias("text"), (~known).alias("added"),
    )
    return out.withColumn("order", F.row_number().over(Window.partitionBy(doc).orderBy("y", "x", "idx")) - 1)


def apply_verdicts(consensus: DataFrame, verdicts: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(gt, blocked).  consensus: on, grade, parser_changed, parser, label;
    verdicts: on, verdict, correct.  Low or changed labels wait for a verdict;
    parser, model and other choose the label; what cannot be settled says why."""
    j = consensus.join(verdicts, on, "left")
    v, fix = F.lower(F.trim("verdict")), F.trim(F.coalesce("correct", F.lit("")))
    none = F.coalesce(v, F.lit("")) == ""
    reason = (
        F.when(none & ((F.col("grade") == "low") | F.col("parser_changed")), "waiting").when(none, None).when((v == "other") & (fix == ""), "no_correction").when(~v.isin("parser", "model", "other"), "unknown_verdict")
    )
    label = F.when(v == "parser", F.col("parser")).when(v == "other", fix).otherwise(F.col("label"))
    settled = j.withColumn("reason", reason).withColumn("final", label).withColumn("verified", ~none)
    return settled.where("reason is null").select(on, "grade", F.col("final").alias("label"), "verified"), settled.where("reason is not null").select(on, "grade", "reason")


def upsert(log: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(log, changes): new values over old ones where they are not null, new keys
    appended; a row of changes for each cell that differs."""
    cols = [c for c in log.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"{c}__new") for c in cols if c in updates.columns])
    j = log.join(new, key, "full_outer")
    merged = j.select(key, *[F.coalesce(f"{c}__new", c).alias(c) if c in updates.columns else F.col(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("old"), F.col(f"{c}__new").cast("string").alias("new")) for c in cols if c in updates.columns])
    changes = j.select(key, F.inline(cells)).where("new is not null and not (old <=> new)")
    return merged, changes


def collect_since(files: DataFrame, known: DataFrame, on: str, modified: str, cutoff, include: DataFrame | None = None) -> DataFrame:
    """Files changed after the cutoff, or on a list of ids, each new or updated."""
    picked = files.where(F.col(modified) > F.lit(cutoff))
    if include is not None:
        picked = picked.unionByName(files.where(F.col(modified) <= F.lit(cutoff)).join(include, on, "left_semi"))
    return picked.join(known.select(on).distinct().withColumn("k_", F.lit(True)), on, "left").withColumn("state", F.when(F.col("k_"), "updated").otherwise("new")).drop("k_")
