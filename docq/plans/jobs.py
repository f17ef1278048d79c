"""Composite jobs: one function each, from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docq.functions import ids, metric, text
from docq.operators import agg, joins, reshape, rules, sampling, setops, tables


def validate(df: DataFrame, answer: str) -> DataFrame:
    """flags of every answer, all rules in one pass over the text."""
    d = rules.meta_phrases(rules.fence_residue(rules.bad_chars(rules.repeated_line(rules.length_flag(df, answer), answer), answer), answer), answer)
    parts = [
        F.col("length_flag"), F.when(F.col("repeated_line"), "repeated_line"), F.when(F.col("replacement_char"), "replacement_char"), F.when(F.col("control_char"), "control_char"),
        F.when(F.col("fence_residue"), "fence"), F.when(F.col("meta_phrase"), "meta"),
    ]
    return d.select(*df.columns, F.array_compact(F.array(*parts)).alias("flags"))


def consensus(df: DataFrame, parser: str, model_a: str, model_b: str, tol: float = 0.02, distance=None) -> DataFrame:
    """grade (high: all agree, mid: two do, low), label and parser_changed.  Texts
    agree within tol of error on their comparison keys; the parser's own text is
    kept wherever it is on the majority's side."""
    distance = distance or metric.cer
    keys = F.struct(*[text.compare_key(F.col(c)).alias(n) for c, n in ((parser, "p"), (model_a, "a"), (model_b, "b"))])

    def verdict(k: Column) -> Column:
        agree = F.struct(*[(distance(k[x], k[y]) <= tol).alias(x + y) for x, y in ("pa", "pb", "ab")], (k["a"] != k["p"]).alias("differs"))

        def judged(s: Column) -> Column:
            by_a = ~s["pa"] & ~s["pb"] & s["ab"]
            grade = F.when(s["pa"] & s["pb"] & s["ab"], "high").when(s["pa"] | s["pb"] | s["ab"], "mid").otherwise("low")
            return F.struct(grade.alias("grade"), by_a.alias("by_a"), (by_a & s["differs"]).alias("changed"))

        return let(agree, judged)

    d = df.withColumn("v_", let(keys, verdict))
    label = F.when(F.col("v_.by_a"), F.col(model_a)).otherwise(F.col(parser))
    return d.withColumns({"grade": F.col("v_.grade"), "label": label, "parser_changed": F.col("v_.changed")}).drop("v_")


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def review_queue(df: DataFrame, on: str) -> DataFrame:
    """Rows for a person: low or changed ones, low first, with a blank verdict."""
    q = df.where((F.col("grade") == "low") | F.col("parser_changed"))
    return q.select(on, "grade", "label", F.lit("").alias("verdict"), F.when(F.col("grade") == "low", 0).otherwise(1).alias("turn"))


def trainset_consensus(df: DataFrame, on: str, ratio: float = 0.35, val_ratio: float = 0.05, min_val: int = 10, seed: int = 0) -> DataFrame:
    """High grades are clean, mid ones hard, low ones dropped; balanced, then split."""
    graded = df.where(F.col("grade") != "low").withColumn("is_hard", F.col("grade") == "mid")
    return sampling.random_split(sampling.balance(graded, "is_hard", on, ratio, seed), on, val_ratio, min_val, seed)


def mix_select(structured: DataFrame, layered: DataFrame, tables: DataFrame, text_col: str, doc: str, n: int, seed: int = 0) -> DataFrame:
    """The three picks of a mix with the source of each row."""
    picks = {
        "structure": sampling.topk_structure(structured, text_col, doc, n).select(doc),
        "length": sampling.bucket_quota(layered, text_col, doc, n, seed=seed).select(doc),
        "table": sampling.topk_table_complexity(tables, text_col, doc, n).select(doc),
    }
    return setops.union_tagged(picks)


def mix_oversample(small: DataFrame, large: DataFrame, doc: str, repeat: int, limit_large: int, val_ratio: float = 0.05, seed: int = 0) -> DataFrame:
    """Both sources with val carved out first; training rows of the small one repeated."""
    out = {}
    drawn = large.orderBy(ids.draw(seed, F.col(doc).cast("string")), doc).limit(limit_large)
    for name, df in (("small", small), ("large", drawn)):
        s = sampling.hash_split(df, doc, (1 - val_ratio, val_ratio), seed)
        train = s.where("split = 'train'")
        train = sampling.oversample(train, repeat) if name == "small" else train.withColumn("copy", F.lit(1))
        out[name] = train.unionByName(s.where("split <> 'train'").withColumn("copy", F.lit(1)))
    return setops.union_tagged(out)


def score_predictions(manifest: DataFrame, predictions: DataFrame, on: str) -> DataFrame:
    """Micro and macro scores of each model; only predicted texts are trusted, gt is read anew."""
    p = manifest.join(predictions, on)
    s = p.select("model", "task", metric.cer(F.col("gt"), F.col("pred")).alias("cer"), (F.col("gt") == F.col("pred")).alias("ok"))
    return agg.micro_macro(s, "model", "task", "cer", "ok")


def kie_scores(gt: DataFrame, pred: DataFrame, on: list[str]) -> DataFrame:
    """A score for each field of gt: joins.eval_left with metric.value_score.
    gt: on, field, value; pred: on, field, value."""
    p = pred.withColumnRenamed("value", "pred")
    j = joins.eval_left(gt, p, [*on, "field"])
    return j.withColumn("score", F.when(F.col("status") == "ok", metric.value_score(F.col("pred"), F.col("value"))))


def parser_vs_gt(gt: DataFrame, pred: DataFrame, doc: str, idx: str, thr: float = 0.5) -> DataFrame:
    m = joins.iou_match(gt, pred, doc, idx, thr)
    return agg.detection(m, pred, doc)


def checkpoint_report(scores: DataFrame, step: str, task: str, arm: str, cer: str, arms: list[str]) -> DataFrame:
    """Mean CER of each arm by checkpoint and task."""
    return scores.groupBy(step, task).pivot(arm, arms).agg(F.avg(cer))


def panel_index(scores: DataFrame, on: str, arm: str, as_is: str, to_be: str) -> DataFrame:
    """A row for each case of a side-by-side panel: on, gt_chars, of either arm its text's
    length, CER and whether it is exact, the gain (CER saved), and the verdict: better,
    worse, same or missing (an arm has no text).  scores: on, arm, gt, pred.
    Of repeated rows of an arm the largest text counts."""
    picked = scores.where(F.col(arm).isin(as_is, to_be)).groupBy(on).agg(
        F.max("gt").alias("gt"), *[F.max(F.when(F.col(arm) == a, F.col("pred"))).alias(n) for a, n in ((as_is, "a"), (to_be, "b"))]
    )
    both = picked.select(on, F.length("gt").alias("gt_chars"), *[
        c for n, name in (("a", "as_is"), ("b", "to_be"))
        for c in (F.length(n).alias(f"{name}_chars"), F.when(F.col(n).isNotNull(), metric.cer(F.col("gt"), F.col(n))).alias(f"{name}_cer"), (F.col("gt") == F.col(n)).alias(f"{name}_exact"))
    ])
    gain = F.col("as_is_cer") - F.col("to_be_cer")
    verdict = F.when(gain.isNull(), "missing").when(gain > 0, "better").when(gain < 0, "worse").otherwise("same")
    return both.withColumn("gain", gain).withColumn("verdict", verdict)


def unseen_pool(pool: DataFrame, seen: DataFrame, on: str, doc: str, order: list[str], n: int) -> DataFrame:
    """n rows that training has not seen, at most one of each document."""
    from docq.operators.win import one_per_group

    return one_per_group(joins.unseen(pool, seen, on), doc, order).orderBy(*order).limit(n)


def apply_review(consensus: DataFrame, verdicts: DataFrame, on: str, excluded: list[str]) -> tuple[DataFrame, DataFrame]:
    """(gt, blocked): labels that consensus or a reviewer settles, in one spelling, and
    the rows that wait with the reason.  Rows whose image names an excluded label are
    left out.  consensus: on, image, grade, parser_changed, parser, label; verdicts:
    on, verdict, correct."""
    out = reduce(lambda a, b: a | b, [F.coalesce(F.col("image"), F.lit("")).contains(x) for x in excluded], F.lit(False))
    kept = consensus.where(~out)
    gt, blocked = setops.apply_verdicts(kept, verdicts, on)
    source = F.when(F.col("verified"), "human").otherwise("consensus")
    return gt.join(kept.select(on, "image"), on).select(on, "image", "grade", text.canon(F.col("label")).alias("label"), "verified", source.alias("source")), blocked


def taxonomy_tree(rows: DataFrame, tasks: DataFrame, package: str, task: str) -> tuple[DataFrame, DataFrame]:
    """(records, registry): package rows under the category and data set of their task,
    and a row for each file of the tree.  tasks: package, task, dataset_name, category
    (a row for each pair).  A task that is not listed fails the job."""
    named = rows.join(tasks, [package, task], "left")
    unknown = F.raise_error(F.concat(F.lit("no category for task "), F.coalesce(F.col(task), F.lit("null"))))
    records = named.withColumn("category", F.coalesce("category", unknown.cast("string")))
    files = records.groupBy(package, "dataset_name", "category").agg(F.count("*").alias("sample_count"))
    return records, files.withColumn("path", F.concat_ws("/", package, "dataset_name", F.concat("category", F.lit(".json"))))


def kie_eval(scores: DataFrame, doc: str, by: str) -> tuple[DataFrame, DataFrame]:
    """(documents, figures): sums of scores by document, and their weighted accuracy by
    type and in total.  scores: doc, by, part ("general" or "table"), row (of a table),
    score (null where nothing was predicted, which counts as 0), in_gt, in_pred."""
    score = F.coalesce("score", F.lit(0.0)).cast("decimal(20,6)")

    def of(part: str, x: Column) -> Column:
        return F.when(F.col("part") == part, x)

    def rows_in(side: str) -> Column:
        return F.count_distinct(F.when((F.col("part") == "table") & F.col(side), F.col("row")))

    docs = scores.groupBy(doc, by).agg(
        *[F.coalesce(F.sum(of(p, score)).cast("double"), F.lit(0.0)).alias(f"{p}_score") for p in ("general", "table")],
        *[F.count(of(p, F.lit(1))).alias(f"{p}_n") for p in ("general", "table")],
        rows_in("in_gt").alias("gt_rows"), rows_in("in_pred").alias("pred_rows"), F.count("score").alias("predicted"),
    )
    return docs, agg.kie_weighted(docs, by)


def kie_low_accuracy(docs: DataFrame, scores: DataFrame, doc: str, threshold: float = 0.70) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(low, causes, fields) of kie_eval's documents: those under the threshold or
    without a prediction; how many by cause; and of their fields the failures, most first.
    scores as for kie_eval, with field."""
    n = F.col("general_n") + F.col("table_n")
    accuracy = F.when((n > 0) & (F.col("predicted") > 0), (F.col("general_score") + F.col("table_score")) / n)
    low = docs.withColumn("accuracy", accuracy).where(accuracy.isNull() | (accuracy < threshold))
    cause = (
        F.when(F.col("predicted") == 0, "no_prediction").when(F.col("gt_rows") != F.col("pred_rows"), "row_mismatch")
        .when(F.col("table_score") * F.col("general_n") < F.col("general_score") * F.col("table_n"), "table").otherwise("general")
    )
    low = low.withColumn("cause", cause)
    bad = scores.join(low.select(doc), doc, "left_semi").where(F.coalesce("score", F.lit(0.0)) < 1)
    return low, low.groupBy("cause").agg(F.count("*").alias("n")), bad.groupBy("field").agg(F.count("*").alias("failures"), F.count_distinct(doc).alias("docs"))


def low_accuracy(docs: DataFrame, cause: Column, metric_col: str, threshold: float = 0.70) -> DataFrame:
    """cause, n of documents under the threshold or without a prediction."""
    low = docs.where((F.col(metric_col) < threshold) | F.col(metric_col).isNull())
    return low.select(cause.alias("cause")).groupBy("cause").agg(F.count("*").alias("n"))


def field_vqa(fields: DataFrame, questions: DataFrame, doc: str) -> DataFrame:
    """A question and answer for each field without flags that has a question.
    fields: doc, field, value; questions: field, question."""
    clean = fields.where(F.size(rules.field_flags(F.col("field"), F.col("value"))) == 0)
    return clean.join(questions, "field").select(doc, "field", "question", F.trim("value").alias("answer"))


def clean_docs(docs: DataFrame, item_total: str, tax: str, total: str) -> DataFrame:
    """Documents with their issues and whether they pass: no flagged field, sums right.
    docs: doc_id, fields, items and the named amounts."""
    d = rules.verify_items(docs, "items", item_total, tax, total)
    flagged = F.filter(F.map_entries("fields"), lambda e: F.size(rules.field_flags(e["key"], e["value"])) > 0)
    return d.withColumn("flags", F.transform(flagged, lambda e: e["key"])).withColumn("passed", (F.size("issues") == 0) & (F.size("flags") == 0))


def unify_receipts(layered: DataFrame, stratum: str, grouped: DataFrame, group: str, doc: str, cap: int, seed: int = 0) -> DataFrame:
    """Two sources in one split: one by strata, the other by whole groups, of whose
    evaluation rows each group keeps at most `cap`, the rest going to training."""
    a = sampling.stratified_split(layered, stratum, doc, seed=seed).select(doc, "split")
    b = sampling.group_split(grouped, group, seed=seed)
    held = b.where("split <> 'train'")
    kept = sampling.cap_per_group(held, group, doc, cap, seed).select(doc, "split")
    over = held.join(kept.select(doc), doc, "left_anti").select(doc, F.lit("train").alias("split"))
    return setops.union_tagged({"layered": a, "grouped": b.where("split = 'train'").select(doc, "split").unionByName(kept).unionByName(over)})


def doc_report(gt: DataFrame, pred: DataFrame, texts: DataFrame, doc: str) -> DataFrame:
    """Each field of gt with its prediction, score and whether the text holds it.
    gt, pred: doc, field, value; texts: doc, text."""
    s = kie_scores(gt, pred, [doc]).join(texts, doc, "left")
    return s.select(doc, "field", F.col("value").alias("gt"), "pred", "status", "score", F.coalesce(F.col("text").contains(F.col("value")), F.lit(False)).alias("in_text"))


def page_ocr_pack(boxes: DataFrame, doc: str, idx: str, drops: DataFrame) -> DataFrame:
    """doc, text of the pages that no reason drops: lines top to bottom, words left to right.
    boxes: doc, idx, x1, y1, x2, y2, word; drops: doc, reason."""
    from docq.operators.win import with_line

    kept = boxes.select(doc, idx, "x1", "y1", "y2", "word").join(drops.where("reason is not null").select(doc), doc, "left_anti")
    lined = with_line(kept, doc, idx)
    words = lined.groupBy(doc, "line").agg(F.sort_array(F.collect_list(F.struct("x1", idx, "word"))).alias("w"))
    pages = words.select(doc, "line", F.array_join("w.word", " ").alias("t")).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("line", "t"))).alias("l"))
    return pages.select(doc, F.array_join("l.t", "\n").alias("text"))


def table_compare(gt_rows: DataFrame, pred_cells: DataFrame, doc: str, header: str = r"^제\s*\d+\s*기") -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of true tables against read ones, rows aligned by their names.
    gt_rows: doc, row, name, numbers (array of texts); pred_cells: doc, row, col, text.

    rows: doc, gt_row, pred_row (null on the side that lacks the row), gt, pred (the
    names), status (equal, misread, missing, spurious), name_cer, and numbers: col,
    gt, pred, ok where either side has text.  Read rows of one cell, without a name
    or with a header's are left out.  summary: one row for each document of either side."""
    none = "CAST(array() AS array<struct<row:int,name:string,{}>>)"
    g = gt_rows.select(doc, F.struct(F.col("row").cast("int").alias("row"), F.coalesce("name", F.lit("")).alias("name"), "numbers").alias("r"))
    g = g.groupBy(doc).agg(F.sort_array(F.collect_list("r")).alias("g"))
    p = pred_cells.groupBy(doc, "row").agg(F.sort_array(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), "text"))).alias("c"))
    name = F.coalesce(F.get(F.filter("c", lambda c: c["col"] == 0), F.lit(0))["text"], F.lit(""))
    p = p.withColumn("name", name).where((F.size("c") >= 2) & (F.trim("name") != "") & ~F.col("name").rlike(header))
    p = p.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col("row").cast("int").alias("row"), "name", "c"))).alias("p"))
    both = g.join(p, doc, "full_outer").select(
        doc, F.coalesce("g", F.expr(none.format("numbers:array<string>"))).alias("g"), F.coalesce("p", F.expr(none.format("c:array<struct<col:int,text:string>>"))).alias("p")
    )
    pairs = F.transform(tables.seq_align("g.name", "p.name"), lambda m: F.struct(m["gt_row"].alias("gt_row"), m["pred_row"].alias("pred_row"), F.get("g", m["gt_row"]).alias("g"), F.get("p", m["pred_row"]).alias("p")))
    m = both.select(doc, F.explode(pairs).alias("m")).select(doc, "m.*")

    def number(x: Column, i: Column) -> Column:
        read = F.get(F.filter("p.c", lambda c: c["col"] == i + 1), F.lit(0))["text"]
        a, b = (F.trim(F.coalesce(v, F.lit(""))) for v in (x, read))
        return F.struct((i + 1).alias("col"), a.alias("gt"), b.alias("pred"), (a == b).alias("ok"))

    matched = F.col("g").isNotNull() & F.col("p").isNotNull()
    status = F.when(F.col("p").isNull(), "missing").when(F.col("g").isNull(), "spurious").when(F.col("g.name") == F.col("p.name"), "equal").otherwise("misread")
    numbers = F.when(matched, F.filter(F.transform("g.numbers", number), lambda n: (n["gt"] != "") | (n["pred"] != "")))
    error = F.when(matched, metric.cer_opcode("g.name", "p.name"))
    rows = m.select(doc, "gt_row", "pred_row", F.col("g.name").alias("gt"), F.col("p.name").alias("pred"), status.alias("status"), error.alias("name_cer"), numbers.alias("numbers"))

    def listed(kind: str, item) -> Column:
        place = F.struct(F.coalesce("gt_row", "pred_row").alias("i"), item.alias("x"))
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("status") == kind, place))), lambda s: s["x"])

    chars = F.when(F.col("name_cer").isNotNull(), F.length("gt"))
    wrong = F.filter("numbers", lambda n: ~n["ok"])
    s = rows.groupBy(doc).agg(
        F.count("gt_row").alias("gt_rows"), F.count("pred_row").alias("pred_rows"), F.count("name_cer").alias("n_"), listed("missing", F.col("gt")).alias("missing_rows"),
        listed("spurious", F.col("pred")).alias("spurious_rows"), F.sum(F.col("name_cer") * chars).alias("err_"), F.sum(chars).alias("chars_"),
        listed("misread", F.struct("gt", "pred")).alias("name_errors"), F.coalesce(F.sum(F.size("numbers")), F.lit(0)).alias("numeric_cells"), F.sum(F.size(wrong)).alias("wrong_"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.size(wrong) > 0, F.struct("gt_row", F.col("gt").alias("name"), wrong.alias("w"))))),
                              lambda r: F.transform(r["w"], lambda n: F.struct(r["name"].alias("row"), n["col"].alias("col"), n["gt"].alias("gt"), n["pred"].alias("pred"))))).alias("numeric_errors"),
    )
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    n = F.col("numeric_cells")
    return rows, s.select(
        doc, "gt_rows", "pred_rows", ratio(F.col("n_"), F.col("gt_rows")).alias("row_recall"), "missing_rows", "spurious_rows", ratio(F.col("err_"), F.col("chars_")).alias("name_cer"),
        F.size("name_errors").alias("name_error_count"), "name_errors", "numeric_cells", ratio(n - F.col("wrong_"), n).alias("numeric_accuracy"), "numeric_errors",
    )


def block_scores(blocks: DataFrame, layout: DataFrame, doc: str, idx: str, tol: float = 6) -> DataFrame:
    """blocks with whole coordinates and the score of the first layout box within tol, or null."""
    corners = ("x1", "y1", "x2", "y2")
    whole = {c: F.bround(c) for c in corners}
    boxes = layout.withColumns(whole).groupBy(doc, *corners).agg(F.min(idx).alias("first_"), F.max_by("score", idx).alias("score"))
    b = blocks.withColumns(whole)
    here = boxes.select(F.col(doc).alias("d_"), "first_", "score", *[F.col(c).alias(f"o_{c}") for c in corners])
    apart = F.greatest(*[F.abs(F.col(c) - F.col(f"o_{c}")) for c in corners])
    # All of it goes by the document, so that nothing after the join shuffles.
    met = b.withColumn("row_", F.monotonically_increasing_id()).join(here, (F.col(doc) == F.col("d_")) & (apart < tol), "left")
    return met.groupBy(*b.columns, "row_").agg(F.min_by("score", "first_").alias("score")).drop("row_")


def diff_runs(a: DataFrame, b: DataFrame, doc: str, idx: str, max_dist: float = 60, min_delta: float = 0.02, docs: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes, summary) of two runs, blocks paired by place (joins.matched_l1).
    a, b: doc, idx, x1, y1, x2, y2, label, content, order, score (block_scores); docs as matched_l1 has it.

    changes: doc, a_idx, b_idx, label, change (only_a, only_b, filled, emptied,
    text_changed, score_up, score_down, order_changed), a, b (the two values as text),
    chars, delta; a pair may change in text, score and order at once.  summary: the
    blocks of both runs and the count of each change, for each document of either run."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""), r"(?U)[\s\x1c-\x1f]+", "")
    side = lambda df: df.select(doc, idx, "x1", "y1", "x2", "y2", "label", "content", F.col("order").cast("string").alias("order"), "score", bare(F.col("content")).alias("bare"))
    j = joins.matched_l1(side(a), side(b), doc, idx, max_dist, docs).select(doc, "a", "b", F.col(f"a.{idx}").alias("a_idx"), F.col(f"b.{idx}").alias("b_idx"))
    x, y, delta = F.col("a.bare"), F.col("b.bare"), F.col("b.score") - F.col("a.score")

    def change(kind: Column, n: str | None = None, chars: Column | None = None, by: Column | None = None) -> Column:
        values = [(F.col(f"{s}.{n}").cast("string") if n else F.lit(None).cast("string")).alias(s) for s in ("a", "b")]
        made = F.struct(kind.alias("change"), *values, (chars if chars is not None else F.lit(None).cast("int")).alias("chars"), (by if by is not None else F.lit(None).cast("double")).alias("delta"))
        return F.when(kind.isNotNull(), made)

    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    lone = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b")
    read = F.when(both & (x == "") & (y != ""), "filled").when(both & (x != "") & (y == ""), "emptied").when(both & (x != y), "text_changed")
    score = F.when(F.abs(delta) > min_delta, F.when(delta > 0, "score_up").otherwise("score_down"))
    order = F.when(both & ~F.col("a.order").eqNullSafe(F.col("b.order")), "order_changed")
    chars = F.when(read == "filled", F.length(y)).when(read == "emptied", F.length(x))
    found = F.array_compact(F.array(change(lone), change(read, "content", chars), change(score, "score", by=F.round(delta, 4)), change(order, "order")))
    rows = j.select(doc, "a_idx", "b_idx", F.coalesce("a.label", "b.label").alias("label"), found.alias("found"))
    changes = rows.select(doc, "a_idx", "b_idx", "label", F.explode("found").alias("c")).select(doc, "a_idx", "b_idx", "label", "c.*")
    kinds = ("text_changed", "score_up", "score_down", "filled", "emptied", "order_changed", "only_a", "only_b")
    counts = [F.sum(F.array_contains("found.change", k).cast("bigint")).alias(k) for k in kinds]
    return changes, rows.groupBy(doc).agg(F.count("a_idx").alias("blocks_a"), F.count("b_idx").alias("blocks_b"), *counts)


def upload_mix(small: DataFrame, large: DataFrame, blocks_: DataFrame, inventory: DataFrame, doc: str, repeat: int = 8, n_large: int = 3000, val: int = 200, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mix, shares, missing) of two sources with validation rows taken from each first.
    small, large: doc, images (array), answer; blocks_: reshape.blocks; inventory: ref.

    mix: source, split, copy, doc, images, answer, regenerated.  Answers of the small
    source are built anew from their blocks (tables stay HTML), or kept where there are
    none; its training rows are repeated, the large source gives n_large (0: all).
    shares: split, source, n, share.  missing: root, n of images that the inventory lacks."""
    md = reshape.build_markdown(blocks_, doc, (), ("doc_title",), ("paragraph_title",)).select(doc, F.trim("markdown").alias("md_")).where("md_ <> ''")
    anew = small.join(md, doc, "left").withColumn("regenerated", F.col("md_").isNotNull()).withColumn("answer", F.coalesce("md_", "answer")).drop("md_")
    n_small = max(8, val // 8) if val > 0 else 0
    out = []
    for name, df, held, limit in (("small", anew, n_small, 0), ("large", large.withColumn("regenerated", F.lit(False)), max(0, val - n_small), n_large)):
        keys = df.select(doc, ids.draw(seed, F.col(doc).cast("string")).alias("k_"))
        v = keys.orderBy("k_", doc).limit(held).select(doc)
        rest = keys.join(v, doc, "left_anti")
        train = (rest.orderBy("k_", doc).limit(limit) if limit else rest).select(doc)
        copies = F.sequence(F.lit(1), F.lit(repeat if name == "small" else 1))
        parts = df.join(train, doc, "left_semi").select("*", F.lit("train").alias("split"), F.explode(copies).alias("copy"))
        parts = parts.unionByName(df.join(v, doc, "left_semi").select("*", F.lit("val").alias("split"), F.lit(1).alias("copy")))
        out.append(parts.select(F.lit(name).alias("source"), "split", "copy", doc, "images", "answer", "regenerated"))
    mix = out[0].unionByName(out[1])
    counts = mix.groupBy("split", "source").agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))
    return mix, shares, rules.missing_refs(mix, "images", inventory)
