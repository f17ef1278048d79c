"""Window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docq.operators import scan
from docq.operators.scan import forward_fill, moving_average, quantile_pick, running_total  # noqa: F401


def reading_order(blocks: DataFrame, doc: str, y: str, x: str, tie: str, base: int = 0) -> DataFrame:
    return blocks.withColumn("order", F.row_number().over(Window.partitionBy(doc).orderBy(y, x, tie)) - 1 + base)


def line_group(boxes: DataFrame, doc: str, idx: str) -> DataFrame:
    """doc, idx, line: boxes by (y1, x1); a box opens a line when its top is further
    from the line's first box than max(8, 0.6 x the page's median height).

    Which lines there are follows from the distinct tops of a page alone: they are
    folded in order, each against the top of the line before.  A box is in the last line
    that begins at or above it.  What is held of a page is its distinct tops, not its boxes.
    Boxes with a null doc are one page; a box without a top opens a line, before all others.
    """
    return with_line(boxes.select(doc, idx, "x1", "y1", "y2"), doc, idx).select(doc, idx, "line")


def with_line(boxes: DataFrame, doc: str, idx: str) -> DataFrame:
    """boxes with the line of line_group, so that no join brings their other columns back."""
    tol = F.greatest(F.lit(8.0), 0.6 * F.median(F.col("y2") - F.col("y1")))
    pages = boxes.groupBy(F.col(doc).alias("d_")).agg(tol.alias("tol"), F.sort_array(F.collect_set(F.col("y1").cast("double"))).alias("tops"), F.count_if(F.col("y1").isNull()).alias("bare"))

    def step(starts, y):
        return F.when(y - F.element_at(starts, -1) > F.col("tol"), F.array_append(starts, y)).otherwise(starts)

    starts = F.aggregate("tops", F.array().cast("array<double>"), lambda acc, y: F.when(F.size(acc) == 0, F.array(y)).otherwise(step(acc, y)))
    pages = pages.select("d_", starts.alias("starts"), "bare")
    rows = boxes.join(pages, F.col(doc).eqNullSafe(F.col("d_")))
    line = F.size(F.filter("starts", lambda s: s <= F.col("y1").cast("double"))) - 1 + F.col("bare")
    topped = rows.where("y1 is not null").select(*boxes.columns, line.cast("int").alias("line"))
    bare = scan.row_index(boxes.where("y1 is null"), doc, ["x1", idx])
    return topped.unionByName(bare.select(*boxes.columns, F.col("i_").cast("int").alias("line")))


def one_per_group(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("nth_ = 1").drop("nth_")


def rank_agreement(df: DataFrame, model: str, split: str, metric: str, splits: tuple[str, str]) -> DataFrame:
    """model, the rank in either split (best first), and whether they agree."""
    ranked = df.withColumn("r", F.rank().over(Window.partitionBy(split).orderBy(F.desc(metric))))
    a, b = (ranked.where(F.col(split) == s).select(model, F.col("r").alias(f"rank_{i}")) for i, s in enumerate(splits))
    return a.join(b, model).withColumn("agree", F.col("rank_0") == F.col("rank_1"))


def best_per_slot(df: DataFrame, slot: str, item: str, score: str, lower: bool, keep: int = 3) -> DataFrame:
    """slot, best, candidates: the best `keep` of each slot, as evidence."""
    order = Window.partitionBy(slot).orderBy(F.asc(score) if lower else F.desc(score), item)
    few = df.withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= keep)
    c = F.sort_array(F.collect_list(F.struct("r_", F.col(item).cast("string").alias("item"))))
    return few.groupBy(slot).agg(c.alias("c")).select(slot, F.col("c")[0]["item"].alias("best"), F.array_join("c.item", ",").alias("candidates"))


def bands(df: DataFrame, score: str, edges: list[float]) -> DataFrame:
    """band, n: rows by the highest edge that their score reaches; -1 below all."""
    s, out = F.col(score), F.lit(-1.0)
    for e in sorted(edges):
        out = F.when(s >= e, float(e)).otherwise(out)
    return df.groupBy(out.alias("band")).agg(F.count("*").alias("n"))


def vs_baseline(df: DataFrame, name: str, metric: str, baseline: str, higher_better: bool) -> DataFrame:
    """delta against the baseline's metric, and whether it is better."""
    base = df.where(F.col(name) == baseline).select(F.col(metric).alias("base_"))
    d = df.crossJoin(F.broadcast(base))  # one row
    delta = F.col(metric) - F.col("base_")
    return d.withColumn("delta", delta).withColumn("better", delta > 0 if higher_better else delta < 0).drop("base_")
