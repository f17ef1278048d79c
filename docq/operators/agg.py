"""Aggregates for scoring and profiling: built-in, partial before the shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def reason_counts(df: DataFrame, flags: str) -> DataFrame:
    """reason, n of an array of flags; a row counts under each of its flags."""
    return df.select(F.explode(flags).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def score_by(df: DataFrame, gt: str, pred: str, keys: list[str]) -> DataFrame:
    """n, mean CER, exact rate and digit accuracy by each key and in total, in one pass.
    Digit accuracy is over rows whose gt has digits."""
    from docq.functions import metric, num

    d = num.digits(F.col(gt))
    rows = df.select(
        *keys, metric.cer(F.col(gt), F.col(pred)).alias("cer"), (F.col(gt) == F.col(pred)).alias("exact"), F.when(d != "", (d == num.digits(F.col(pred))).cast("int")).alias("digits")
    )
    sets = [[k] for k in keys] + [[]]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(
        F.count("*").alias("n"), F.avg("cer").alias("cer"), F.avg(F.col("exact").cast("double")).alias("exact"), F.avg("digits").alias("digit_accuracy")
    )


def micro_macro(scores: DataFrame, model: str, task: str, value: str, ok: str) -> DataFrame:
    """n, micro (mean of rows), macro (mean of the tasks' means) and exact count of each model."""
    by_task = scores.groupBy(model, task).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.avg(value).alias("m"), F.count_if(ok).alias("exact"))
    return by_task.groupBy(model).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("micro"), F.avg("m").alias("macro"), F.sum("exact").alias("exact"))


def experiment_metrics(scores: DataFrame, model: str, cer: str, drop: DataFrame, on: str) -> DataFrame:
    """Median and mean CER, rows above 1 and exact share of each model, without listed rows."""
    kept = scores.join(drop, on, "left_anti")
    return kept.groupBy(model).agg(
        F.count("*").alias("n"), F.median(cer).alias("median_cer"), F.avg(cer).alias("mean_cer"), F.count_if(F.col(cer) > 1).alias("over_one"),
        (100 * F.avg((F.col(cer) == 0).cast("double"))).alias("exact_pct"),
    )


def kie_weighted(docs: DataFrame, by: str) -> DataFrame:
    """Sum of scores over sum of fields, for general, table and both, by type and in
    total (null).  Scores are summed exactly, to six places, whatever their order."""

    def ratio(s: Column, n: Column) -> Column:
        return F.when(F.sum(n) > 0, F.sum(s.cast("decimal(20,6)")).cast("double") / F.sum(n))

    g, t = (F.col("general_score"), F.col("general_n")), (F.col("table_score"), F.col("table_n"))
    return docs.rollup(by).agg(
        F.count("*").alias("docs"), ratio(*g).alias("general"), ratio(*t).alias("table"), ratio(g[0] + t[0], g[1] + t[1]).alias("total"), F.count_if(F.col("gt_rows") != F.col("pred_rows")).alias("row_mismatch")
    )


def registry(samples: DataFrame, keys: list[str], first: list[str]) -> DataFrame:
    """Number of samples by keys, with the least value of the columns that a group shares."""
    return samples.groupBy(*keys).agg(F.count("*").alias("sample_count"), *[F.min(c).alias(c) for c in first])


def kie_unweighted(docs: DataFrame, by: str) -> DataFrame:
    """Plain mean of the documents' accuracies; differs from kie_weighted."""
    acc = (F.col("general_score") + F.col("table_score")) / (F.col("general_n") + F.col("table_n"))
    return docs.groupBy(by).agg(F.count("*").alias("docs"), F.avg(acc).alias("accuracy"))


def detection(matches: DataFrame, preds: DataFrame, doc: str) -> DataFrame:
    """One row of detection figures from joins.iou_match and the predictions."""
    m = matches.agg(
        F.count("*").alias("gt"), F.count_if("matched").alias("tp"), F.avg("coverage").alias("coverage"), F.avg((F.col("coverage") >= 0.9).cast("double")).alias("covered"), F.avg("iou").alias("mean_iou")
    )
    p = preds.agg(F.count("*").alias("pred"))
    per_doc = matches.groupBy(doc).agg(F.count("*").alias("g")).join(preds.groupBy(doc).agg(F.count("*").alias("p")), doc, "left")
    ratio = per_doc.agg(F.avg(F.coalesce("p", F.lit(0)) / F.col("g")).alias("preds_per_gt"))
    one = m.crossJoin(p).crossJoin(ratio)  # three single rows
    precision, recall = F.col("tp") / F.col("pred"), F.col("tp") / F.col("gt")
    return one.withColumns({"precision": precision, "recall": recall, "f1": 2 * F.col("tp") / (F.col("pred") + F.col("gt"))})


def containment_tier(value: Column, text: Column) -> Column:
    """exact, all_tokens (of two characters or more), partial, none."""
    tokens = F.filter(F.split(F.lower(value), r"\s+"), lambda t: F.length(t) >= 2)
    low = F.lower(text)
    hits = F.size(F.filter(tokens, lambda t: low.contains(t)))
    return F.when(low.contains(F.lower(value)), "exact").when((F.size(tokens) > 0) & (hits == F.size(tokens)), "all_tokens").when(hits > 0, "partial").otherwise("none")


def outside_region(lines: DataFrame, gt: DataFrame, doc: str, margin: float = 5) -> DataFrame:
    """doc, above, below: predicted lines outside the vertical span of the gt boxes."""
    span = gt.groupBy(doc).agg(F.min("y1").alias("top"), F.max("y2").alias("bottom"))
    return lines.join(span, doc).groupBy(doc).agg(F.count_if(F.col("y2") < F.col("top") - margin).alias("above"), F.count_if(F.col("y1") > F.col("bottom") + margin).alias("below"))


def confusion(df: DataFrame, flag: str, truth: str) -> DataFrame:
    f, t = F.col(flag), F.col(truth)
    c = df.agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & ~t).alias("tn"), F.count_if(~f & t).alias("fn"))
    return c.withColumns({"recall": F.col("tp") / (F.col("tp") + F.col("fn")), "precision": F.col("tp") / (F.col("tp") + F.col("fp")), "review_share": (F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))})


def steady_mean(x: Column | str, places: int = 12) -> Column:
    """The mean of numbers, of which `places` decimals count: summed as decimals, so that the same
    rows give the same mean however they are split over tasks.  For means that meet a threshold.
    With values that are no such decimals (not finite, or of over 16 whole digits) it is avg."""
    c = F.col(x) if isinstance(x, str) else x
    d = c.try_cast(f"decimal({16 + places},{places})")
    return F.when(F.count(d) == F.count(c), F.sum(d).cast("double") / F.count(c)).otherwise(F.avg(c))


def win_loss(df: DataFrame, unit: str, arm: str, metric: str, base: str, eps: float) -> DataFrame:
    """arm, better, worse, same: units whose metric fell or rose by more than eps against the base arm."""
    b = df.where(F.col(arm) == base).select(unit, F.col(metric).alias("b_"))
    d = df.where(F.col(arm) != base).join(b, unit).withColumn("d_", F.col(metric) - F.col("b_"))
    return d.groupBy(arm).agg(F.count_if(F.col("d_") < -eps).alias("better"), F.count_if(F.col("d_") > eps).alias("worse"), F.count_if(F.abs("d_") <= eps).alias("same"))


def arm_pivot(df: DataFrame, tier: str, arm: str, ok: str, arms: list[str]) -> DataFrame:
    """Of each tier, ok and n of each arm."""
    return df.groupBy(tier).pivot(arm, arms).agg(F.count_if(ok).alias("ok"), F.count(F.lit(1)).alias("n"))


def at_index(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Values of a number column at index int(n * share) of the ascending order, one column each.

    Equal values are counted first.  Approximate quantiles of the distinct values cut
    them into 256 ranges; sums of the ranges before one, and a running count inside
    it, give the exact index, so no task orders all values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v_")).agg(F.count("*").alias("c_"))
    cuts = counts.agg(F.percentile_approx("v_", [i / 256 for i in range(1, 256)], 10_000).alias("cuts_"))  # one row
    placed = counts.crossJoin(F.broadcast(cuts)).select("v_", "c_", F.size(F.filter("cuts_", lambda c: c < F.col("v_"))).alias("b_"))
    sums = placed.groupBy("b_").agg(F.sum("c_").alias("s_"))  # at most 256 rows
    base = sums.select("b_", (F.sum("s_").over(Window.orderBy("b_")) - F.col("s_")).alias("at_"), F.sum("s_").over(Window.partitionBy()).alias("n_"))
    inside = F.sum("c_").over(Window.partitionBy("b_").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0))
    running = placed.join(F.broadcast(base), "b_").withColumn("upto_", F.col("at_") + inside)
    picks = [F.min(F.when(F.col("upto_") > F.least(F.floor(F.col("n_") * s), F.col("n_") - 1), F.col("v_"))).alias(name) for name, s in shares.items()]
    return running.agg(*picks)


def token_budget(df: DataFrame, total: str, limit: int) -> DataFrame:
    """Rows over a limit, tokens lost to it, the most, as the next multiple of 1024 too, and
    p50 to p100: totals at index int(n * share) of their order."""
    t = F.col(total)
    sums = df.agg(
        F.count("*").alias("n"), F.count_if(t > limit).alias("over"), F.sum(F.greatest(t - limit, F.lit(0))).alias("lost"), F.max(t).alias("most"), (F.ceil(F.max(t) / 1024) * 1024).cast("bigint").alias("next_1024")
    )
    return sums.crossJoin(at_index(df, total, {f"p{q}": q / 100 for q in (50, 90, 95, 99, 100)}))  # two single rows


def size_profile(df: DataFrame, order: str, w: str, h: str, sample: int = 300, seed: int = 0) -> DataFrame:
    """n, and of a systematic sample the least, middle and greatest width and height and the
    middle size in megapixels (middle: at index n // 2)."""
    from docq.operators.sampling import systematic

    wide, high = F.col(w), F.col(h)
    # A report over a bounded sample: its values are sorted in one row.
    s = systematic(df.where(wide.isNotNull() & high.isNotNull()), order, sample, seed).agg(
        F.count("*").alias("n"), *[F.sort_array(F.collect_list(c)).alias(n) for c, n in ((wide, "w"), (high, "h"), (wide * high / 1e6, "mp"))]
    )
    middle = lambda c: F.get(c, F.floor(F.size(c) / 2).cast("int"))
    edges = [x for n in ("w", "h") for x in (F.get(n, F.lit(0)).alias(f"{n}_min"), middle(n).alias(f"{n}_med"), F.get(n, F.size(n) - 1).alias(f"{n}_max"))]
    return s.select("n", *edges, F.round(middle("mp"), 2).alias("mp_med"))


def item_hits(items: DataFrame, texts: DataFrame, doc: str, by: list[str]) -> DataFrame:
    """by, n, name_hits, price_hits: items whose name, whose price stands in their document's text.
    items: doc, name, price and the columns `by`; texts: doc, text.  An empty name or price is no hit."""
    j = items.join(texts.select(doc, "text"), doc, "left")

    def hit(c: str) -> Column:
        return F.count_if((F.coalesce(F.col(c), F.lit("")) != "") & F.col("text").contains(F.col(c)))

    return j.groupBy(*by).agg(F.count("*").alias("n"), hit("name").alias("name_hits"), hit("price").alias("price_hits"))


def funnel(df: DataFrame, reason: str, order: list[str]) -> DataFrame:
    """step, removed, left: rows that each reason takes away, in order; null reasons stay."""
    counts = df.groupBy(reason).agg(F.count("*").alias("removed"))
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(reason))
    total = df.agg(F.count("*").alias("total"))
    steps = counts.where(F.col(reason).isNotNull()).withColumn("step", rank.cast("int")).crossJoin(total)
    return steps.select("step", reason, "removed", (F.col("total") - F.sum("removed").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))).alias("left"))


def histogram(df: DataFrame, col: str, width: float) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.floor(F.col(col) / width).alias("bin")).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).fillna(0, values)


def provenance(usage: DataFrame, source: str, version: str, item: str) -> DataFrame:
    """Distinct items of each source and version, with totals (null) of rows, columns and all."""
    return usage.cube(source, version).agg(F.count_distinct(item).alias("items"))


def share(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def pass_rate(df: DataFrame, source: str, passed: str) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("docs"), F.count_if(passed).alias("passed"), F.avg(F.col(passed).cast("double")).alias("ratio"))


def field_failures(mismatches: DataFrame, field: str, score: str, example: str, top: int = 25) -> DataFrame:
    """field (row index stripped), fails and the worst example, most failures first (a report of `top`)."""
    bare = F.regexp_replace(field, r"^row[0-9]+\.", "")
    return mismatches.groupBy(bare.alias("field")).agg(F.count("*").alias("fails"), F.min_by(example, F.struct(score, example)).alias("worst")).orderBy(F.desc("fails"), "field").limit(top)


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """model, tokens, requests and cost; null where the model has no price."""
    t = usage.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("requests"))
    return t.join(prices, "model", "left").select("model", "input_tokens", "output_tokens", "requests", ((F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6).alias("cost"))


def correction_outcomes(df: DataFrame, before: str, after: str, truth: str) -> DataFrame:
    """outcome, n: repaired, broken, missed or untouched."""
    b, a = F.col(before) == F.col(truth), F.col(after) == F.col(truth)
    return df.select(F.when(~b & a, "repaired").when(b & ~a, "broken").when(~b & ~a, "missed").otherwise("untouched").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def term_verdict(text: Column, right: Column, wrong: Column) -> Column:
    """correct, same_error, mixed or missing by which of two spellings a text has."""
    r, w = text.contains(right), text.contains(wrong)
    return F.when(r & w, "mixed").when(r, "correct").when(w, "same_error").otherwise("missing")


def doc_wins(scores: DataFrame, doc: str, model: str, good: str) -> DataFrame:
    """doc, model, wins, top: good rows of each model, and whether no model has more."""
    wins = scores.groupBy(doc, model).agg(F.count_if(good).alias("wins"))
    return wins.withColumn("top", (F.col("wins") == F.max("wins").over(Window.partitionBy(doc))) & (F.col("wins") > 0))


def loss_buckets(log: DataFrame, step: str, loss: str, width: int = 100) -> DataFrame:
    b = F.floor(F.col(step) / width)
    return log.groupBy(b.alias("bucket")).agg(F.max(step).alias("step"), F.avg(loss).alias("loss"))


def movement(df: DataFrame, before: str, after: str, task: str, eps: dict[str, float]) -> DataFrame:
    """task, better, same, worse by the task's own tolerance (gain is positive when better)."""
    from docq.functions.metric import signed_gain

    e = F.lit(None).cast("double")
    for t, v in eps.items():
        e = F.when(F.col(task) == t, v).otherwise(e)
    d = df.withColumn("g_", signed_gain(F.col(task), F.col(before), F.col(after))).withColumn("e_", e)
    return d.groupBy(task).agg(F.count_if(F.col("g_") > F.col("e_")).alias("better"), F.count_if(F.abs("g_") <= F.col("e_")).alias("same"), F.count_if(F.col("g_") < -F.col("e_")).alias("worse"))


def failure_matrix(df: DataFrame, kind: str, model: str, models: list[str]) -> DataFrame:
    return df.where(F.col(kind).isNotNull()).groupBy(kind).pivot(model, models).agg(F.count(F.lit(1))).fillna(0, models)


def confidence_split(pairs: DataFrame, correct: str, logprob: str) -> DataFrame:
    return pairs.groupBy(correct).agg(F.count("*").alias("n"), F.avg(logprob).alias("mean"), F.median(logprob).alias("median"), F.min(logprob).alias("least"))


def sweep(df: DataFrame, config: str, tier: str, cer: str, ok: str) -> DataFrame:
    """exact and mean CER of each configuration, by tier and over all (null)."""
    return df.groupingSets([[F.col(config), F.col(tier)], [F.col(config)]], config, tier).agg(F.count("*").alias("n"), F.count_if(ok).alias("exact"), F.avg(cer).alias("cer"))


class _Windows:
    """Hashes of all windows of a text, of any length, from prefix sums modulo 2**64."""

    base = 0x9E3779B97F4A7C15

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        powers, self.back = (np.cumprod(np.full(len(codes), p, dtype=np.uint64)) for p in (self.base, pow(self.base, -1, 1 << 64)))
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * powers, dtype=np.uint64)])

    def hashes(self, k: int, start: int, end: int) -> np.ndarray:
        last = end - k + 1
        return (self.sums[start + k : last + k] - self.sums[start:last]) * self.back[start:last]


def matched_chars(a: str, b: str, small: int = 400) -> int:
    """Characters in the matching blocks that difflib finds (no junk): the longest common piece, first in a,
    then in b, and so on left and right of it.  The longest length is searched by doubling and
    halving over sets of windows, slices where the ranges are small, else hashes that b then confirms."""
    x, y = _Windows(a), _Windows(b)

    def first(k, i0, i1, j0, j1):
        if i1 - i0 + j1 - j0 <= small:
            there = {b[j : j + k] for j in range(j0, j1 - k + 1)}
            return next((i for i in range(i0, i1 - k + 1) if a[i : i + k] in there), None)
        hits = (i0 + int(i) for i in np.flatnonzero(np.isin(x.hashes(k, i0, i1), y.hashes(k, j0, j1))))
        return next((i for i in hits if b.find(a[i : i + k], j0, j1) >= 0), None)

    total, left = 0, [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while left:
        i0, i1, j0, j1, most = left.pop()
        low, at, high, doubling = 0, i0, min(most, i1 - i0, j1 - j0), True
        while low < high:
            k = min(max(1, 2 * low), high) if doubling else (low + high + 1) // 2
            i = first(k, i0, i1, j0, j1)
            if i is None:
                high, doubling = k - 1, False
            else:
                low, at = k, i
        if low:
            j = b.index(a[at : at + low], j0, j1)
            total += low
            left += [(i0, at, j0, j, low), (at + low, i1, j + low, j1, low)]
    return total


@F.pandas_udf(DoubleType())
def matched_share(text: pd.Series, whole: pd.Series) -> pd.Series:
    """Share of a text that difflib's matching blocks find in another."""
    return pd.Series([matched_chars(a, b or "") / len(a) if a else 0.0 for a, b in zip(text, whole, strict=True)], dtype=float)


def doc_coverage(preds: DataFrame, doc: str, gt: str, pred: str) -> DataFrame:
    """doc, coverage: of each document's predictions, the share found in its gts."""
    w = preds.groupBy(doc).agg(F.array_join(F.sort_array(F.collect_list(gt)), "").alias("g"), F.array_join(F.sort_array(F.collect_list(pred)), "").alias("p"))
    # Few short texts cost much to compare: a number of partitions keeps them from being put together.
    w = w.repartition(int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc)
    squash = [F.regexp_replace(c, r"\s+", "") for c in ("p", "g")]
    return w.select(doc, matched_share(*squash).alias("coverage"))


def long_error_scope(df: DataFrame, cer: str, coverage: str, thr: float = 0.9) -> DataFrame:
    """Rows with CER above 1: those whose text the document holds (scope) and the rest (defect)."""
    long = df.where(F.col(cer) > 1)
    return long.agg(F.count_if(F.col(coverage) >= thr).alias("scope"), F.count_if(F.col(coverage) < thr).alias("defect"))
