"""Queries of joins, aggregates, windows, sampling, set operations, reshaping and
tables over the given tables and what is derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docq.functions import geom, ids, metric, tokens
from docq.operators import agg, joins, reshape, rules, sampling, setops, tables, win
from docq.plans import jobs
from docq.plans.catalog import BOXES, CANON, LINES, READS, SCORES, boxes, html_tables, kie_docs, lines, preds, query, reads, responses, scores, t
from docq.sources import io

R6 = lambda c: F.round(c, 6)

# ---- rules over boxes and references ----


@query(
    "flt21_page_drop",
    f"""WITH {BOXES}, b AS (SELECT l_suppkey AS doc, floor(x1 / 15) AS bin, count(*) AS n FROM boxes GROUP BY 1, 2), tl AS (SELECT doc, sum(n) >= 20 AND count(*) FILTER (n >= 5) >= 2 AS tl FROM b GROUP BY 1),
f AS (SELECT l_suppkey AS doc, count(*) AS n, avg(CASE WHEN label = 'R' THEN 1.0 ELSE 0.0 END) AS h FROM boxes GROUP BY 1)
SELECT doc, CASE WHEN n < 5 THEN 'few_boxes' WHEN h > 0.34 THEN 'handwriting' WHEN tl THEN 'table' END AS reason FROM f JOIN tl USING (doc)""",
)
def flt21(spark, d):
    b = boxes(spark, d).selectExpr("l_suppkey AS doc", "x1", "label = 'R' AS hand", "mark")
    return rules.page_drop_reason(b, "doc", "x1", "hand", "mark", hand_max=0.34)


@query(
    "flt22_table_like",
    f"WITH {BOXES}, b AS (SELECT doc, floor(x1 / 15) AS bin, count(*) AS n FROM (SELECT l_suppkey AS doc, x1 FROM boxes) GROUP BY 1, 2) SELECT doc, sum(n) >= 20 AND count(*) FILTER (n >= 5) >= 2 AS table_like FROM b GROUP BY 1",
)
def flt22(spark, d):
    return rules.looks_like_table(boxes(spark, d).selectExpr("l_suppkey AS doc", "x1"), "doc", "x1")


@query("flt23_exclusions", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def flt23(spark, d):
    names = t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return rules.apply_exclusions(t(spark, d, "orders"), names, "o_custkey").select("o_orderkey")


@query(
    "flt24_missing_refs",
    "SELECT l_returnflag AS root, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 30) GROUP BY 1",
)
def flt24(spark, d):
    refs = t(spark, d, "lineitem").select(F.array(F.concat_ws("/", "l_returnflag", F.col("l_partkey").cast("string"))).alias("refs"))
    have = t(spark, d, "part").where("p_size <= 30").select(F.explode(F.array(*[F.concat_ws("/", F.lit(r), F.col("p_partkey").cast("string")) for r in "ANR"])).alias("ref"))
    return rules.missing_refs(refs, "refs", have)


# ---- joins ----


@query(
    "jon01_pair_reasons",
    "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'no_left' ELSE 'no_right' END AS reason FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
)
def jon01(spark, d):
    return joins.pair(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")[1]


@query("jon02_pair", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def jon02(spark, d):
    return joins.pair(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), "doc_id")[0].select("doc_id", "lang", "quality")


@query(
    "jon03_assemble",
    f"""WITH {BOXES}, b AS (SELECT doc, count(*) AS n FROM boxes GROUP BY 1), f AS (SELECT doc, string_agg(label || '=' || v, ',' ORDER BY label) AS fields FROM (SELECT doc, label, max(mark) AS v FROM boxes GROUP BY 1, 2) GROUP BY 1)
SELECT o_orderkey AS doc, coalesce(n, 0) AS n_layout, fields FROM orders LEFT JOIN b ON b.doc = o_orderkey LEFT JOIN f ON f.doc = o_orderkey""",
)
def jon03(spark, d):
    b = boxes(spark, d)
    out = joins.assemble_docs(t(spark, d, "orders").select(F.col("o_orderkey").alias("doc")), b, b.select("doc", F.col("label").alias("field"), F.col("mark").alias("value")), "doc")
    return out.select("doc", "n_layout", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("fields"))


@query(
    "jon04_rescore",
    f"WITH {READS}, s AS (SELECT *, levenshtein(trim(regexp_replace(gt, '\\s+', ' ', 'g')), trim(regexp_replace(pred, '\\s+', ' ', 'g'))) / greatest(length(trim(regexp_replace(gt, '\\s+', ' ', 'g'))), length(trim(regexp_replace(pred, '\\s+', ' ', 'g')))) AS cer FROM reads), g AS (SELECT model, tier, count(*) AS n, sum(cer) AS s, avg(cer) AS m, count(*) FILTER (gt = pred) AS e FROM s GROUP BY 1, 2) SELECT model, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS micro, round(avg(m), 6) AS macro, CAST(sum(e) AS BIGINT) AS exact FROM g GROUP BY 1",
)
def jon04(spark, d):
    r = reads(spark, d)
    out = jobs.score_predictions(r.select("id", "gt", F.col("tier").alias("task")), r.select("id", "model", "pred"), "id")
    return out.select("model", "n", R6("micro").alias("micro"), R6("macro").alias("macro"), "exact")


@query(
    "jon05_eval_left",
    """WITH g AS (SELECT o_orderkey AS doc, o_orderpriority AS v FROM orders), p AS (SELECT o_orderkey AS doc, CASE WHEN o_orderstatus = 'P' THEN lower(o_orderpriority) ELSE replace(o_orderpriority, '-', ' ') END AS v FROM orders WHERE o_totalprice > 50000)
SELECT g.doc, CASE WHEN p.doc IS NULL THEN 'missing_prediction' ELSE 'ok' END AS status, CASE WHEN p.doc IS NOT NULL THEN round(1 - levenshtein(lower(g.v), lower(p.v)) / greatest(length(g.v), length(p.v)), 6) END AS score FROM g LEFT JOIN p ON p.doc = g.doc""",
)
def jon05(spark, d):
    o = t(spark, d, "orders").withColumn("field", F.lit("priority"))
    gt = o.select(F.col("o_orderkey").alias("doc"), "field", F.col("o_orderpriority").alias("value"))
    read = F.when(F.col("o_orderstatus") == "P", F.lower("o_orderpriority")).otherwise(F.replace("o_orderpriority", F.lit("-"), F.lit(" ")))
    pred = o.where("o_totalprice > 50000").select(F.col("o_orderkey").alias("doc"), "field", read.alias("value"))
    return jobs.kie_scores(gt, pred, ["doc"]).select("doc", "status", R6("score").alias("score"))


_PAIR = "SELECT a.doc, a.idx AS a_idx, b.idx AS b_idx, greatest(abs(a.x1 - b.x1), abs(a.y1 - b.y1), abs(a.x2 - b.x2), abs(a.y2 - b.y2)) AS d FROM boxes a JOIN preds b ON a.doc = b.doc"


@query("jon06_box_proximity", f"WITH {BOXES} SELECT doc, a_idx, min(b_idx) AS b_idx FROM ({_PAIR}) WHERE d < 6 GROUP BY 1, 2")
def jon06(spark, d):
    return joins.box_proximity(boxes(spark, d), preds(spark, d), "doc", "idx")


@query("jon07_nearest_box", f"WITH {BOXES} SELECT doc, a_idx, b_idx FROM (SELECT *, row_number() OVER (PARTITION BY doc, a_idx ORDER BY d, b_idx DESC) AS r FROM ({_PAIR}) WHERE d <= 30) WHERE r = 1")
def jon07(spark, d):
    return joins.nearest_box(boxes(spark, d), preds(spark, d), "doc", "idx", 30)


@query(
    "jon08_enclosing_box",
    f"""WITH {BOXES} SELECT doc, a_idx, b_idx FROM (SELECT a.doc, a.idx AS a_idx, b.idx AS b_idx, row_number() OVER (PARTITION BY a.doc, a.idx ORDER BY (b.x2 - b.x1) * (b.y2 - b.y1), b.idx) AS r
FROM boxes a JOIN boxes b ON a.doc = b.doc AND a.idx <> b.idx WHERE b.x1 <= a.x1 + 60 AND b.y1 <= a.y1 + 60 AND b.x2 >= a.x2 - 60 AND b.y2 >= a.y2 - 60) WHERE r = 1""",
)
def jon08(spark, d):
    b = boxes(spark, d)
    return joins.enclosing_box(b, b, "doc", "idx", 60)


# Pairs p (doc, k, a_idx, b_idx) of a document one after another in the order of k, each taken while both sides are unused.
_TAKEN = """g AS (
  SELECT doc, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ua, CAST([] AS BIGINT[]) AS ub, false AS hit FROM (SELECT DISTINCT doc FROM p)
  UNION ALL
  SELECT doc, k, CASE WHEN hit THEN list_append(ua, a_idx) ELSE ua END, CASE WHEN hit THEN list_append(ub, b_idx) ELSE ub END, hit FROM (
    SELECT p.doc, p.k, ua, ub, a_idx, b_idx, NOT list_contains(ua, a_idx) AND NOT list_contains(ub, b_idx) AS hit FROM g JOIN p ON p.doc = g.doc AND p.k = g.k + 1)),
taken AS (SELECT p.* FROM p JOIN g ON p.doc = g.doc AND p.k = g.k WHERE hit)"""
_L1 = "abs(a.x1 - b.x1) + abs(a.y1 - b.y1) + abs(a.x2 - b.x2) + abs(a.y2 - b.y2)"
_NEAR = f"p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY a_idx, d, b_idx) AS k FROM (SELECT a.doc, a.idx AS a_idx, b.idx AS b_idx, {_L1} AS d FROM boxes a JOIN preds b ON a.doc = b.doc) WHERE d < 200)"


@query(
    "jon09_greedy_l1",
    f"""WITH RECURSIVE {BOXES}, {_NEAR}, {_TAKEN}
SELECT doc, a_idx, b_idx FROM taken UNION ALL SELECT doc, idx, NULL FROM boxes WHERE (doc, idx) NOT IN (SELECT (doc, a_idx) FROM taken)
UNION ALL SELECT doc, NULL, idx FROM preds WHERE (doc, idx) NOT IN (SELECT (doc, b_idx) FROM taken)""",
)
def jon09(spark, d):
    return joins.greedy_l1_outer(boxes(spark, d), preds(spark, d), "doc", "idx", 200)


_IOU = f"""{BOXES}, p AS (SELECT a.doc, a.idx AS a_idx, b.idx AS b_idx, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
 (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb FROM boxes a JOIN preds b ON a.doc = b.doc),
m AS (SELECT doc, a_idx, b_idx, i / (sa + sb - i) AS iou, max(i / sa) OVER (PARTITION BY doc, a_idx) AS cov, row_number() OVER (PARTITION BY doc, a_idx ORDER BY i / (sa + sb - i) DESC, b_idx) AS r FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY doc, b_idx, iou >= 0.5 ORDER BY a_idx) AS k FROM m WHERE r = 1),
x AS (SELECT b.doc, b.idx AS a_idx, n.b_idx, coalesce(n.iou, 0) AS iou, coalesce(n.cov, 0) AS cov, coalesce(n.iou >= 0.5 AND n.k = 1, false) AS matched FROM boxes b LEFT JOIN n ON n.doc = b.doc AND n.a_idx = b.idx)"""


@query("jon10_iou_match", f"WITH {_IOU} SELECT doc, a_idx, b_idx, round(iou, 6) AS iou, round(cov, 6) AS coverage, matched FROM x")
def jon10(spark, d):
    return joins.iou_match(boxes(spark, d), preds(spark, d), "doc", "idx").withColumns({"iou": R6("iou"), "coverage": R6("coverage")})


@query(
    "agg07_detection",
    f"""WITH {_IOU}, p2 AS (SELECT count(*) AS pred FROM preds), pd AS (SELECT avg(coalesce(p, 0) / g) AS r FROM (SELECT doc, count(*) AS g FROM boxes GROUP BY 1) LEFT JOIN (SELECT doc, count(*) AS p FROM preds GROUP BY 1) USING (doc))
SELECT count(*) AS gt, count(*) FILTER (matched) AS tp, any_value(pred) AS pred, round(count(*) FILTER (matched) / any_value(pred), 6) AS precision, round(count(*) FILTER (matched) / count(*), 6) AS recall, round(avg(cov), 6) AS coverage,
 round(avg(CASE WHEN cov >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS covered, round(avg(iou), 6) AS mean_iou, round(any_value(r), 6) AS preds_per_gt FROM x, p2, pd""",
)
def agg07(spark, d):
    out = jobs.parser_vs_gt(boxes(spark, d), preds(spark, d), "doc", "idx")
    return out.select("gt", "tp", "pred", *[R6(c).alias(c) for c in ("precision", "recall", "coverage", "covered", "mean_iou", "preds_per_gt")])


@query(
    "jon11_greedy_best",
    f"""WITH RECURSIVE {BOXES}, o AS (SELECT a.doc, a.idx AS a_idx, b.idx AS b_idx, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
 (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb FROM boxes a JOIN preds b ON a.doc = b.doc),
p AS (SELECT doc, a_idx, b_idx, i / (sa + sb - i) AS score, row_number() OVER (PARTITION BY doc ORDER BY i / (sa + sb - i) DESC, a_idx DESC, b_idx DESC) AS k FROM o WHERE i > 0), {_TAKEN}
SELECT doc, a_idx, b_idx, round(score, 6) AS score FROM taken""",
)
def jon11(spark, d):
    a, b = boxes(spark, d), preds(spark, d)
    p = joins._sides(a, b, "doc", "idx").withColumn("score", geom.iou(geom.box("a_"), geom.box("b_"))).where("score > 0")
    return joins.greedy_best(p, "doc", "score").withColumn("score", R6("score"))


@query(
    "jon12_span_overlap",
    f"""WITH {LINES}, s AS (SELECT l_orderkey AS doc, idx * 10 AS s, idx * 10 + l_quantity AS e, -l_discount AS v FROM lines), g AS (SELECT l_orderkey AS doc, idx * 10 + 3 AS a, idx * 10 + 8 AS b FROM lines WHERE l_returnflag = 'R')
SELECT g.doc, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end", min(v) AS logprob FROM g LEFT JOIN s ON s.doc = g.doc AND s.s < b AND s.e > a GROUP BY 1, 2, 3""",
)
def jon12(spark, d):
    rows = lines(spark, d)
    spans = rows.selectExpr("l_orderkey AS doc", "idx * 10 AS start", "idx * 10 + l_quantity AS end", "-l_discount AS logprob")
    targets = rows.where("l_returnflag = 'R'").selectExpr("l_orderkey AS doc", "CAST(idx * 10 + 3 AS BIGINT) AS start", "CAST(idx * 10 + 8 AS BIGINT) AS end")
    return joins.span_overlap(spans, targets, "doc", "logprob")


@query("jon13_contains", "SELECT p_partkey, contains(p_name, CAST(p_size AS VARCHAR)) OR false AS has_size, contains(p_name, lower(substr(p_type, 1, 2))) AS found FROM part")
def jon13(spark, d):
    p = t(spark, d, "part")
    fields = p.select("p_partkey", F.lower(F.substring("p_type", 1, 2)).alias("value"), F.col("p_size").cast("string").alias("size"))
    out = joins.contains(fields, p.select("p_partkey", "p_name"), "p_partkey", "value", "p_name")
    return out.select("p_partkey", F.col("p_name").contains(F.col("size")).alias("has_size"), "found")


@query("jon14_unseen", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jon14(spark, d):
    return joins.unseen(t(spark, d, "documents"), t(spark, d, "labels").select("doc_id"), "doc_id").select("doc_id")


@query("jon15_todo", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jon15(spark, d):
    return joins.todo(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id", F.col("quality") == 1)


@query("jon16_control_group", "SELECT doc_id, md5('7|' || doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY k, doc_id LIMIT 50")
def jon16(spark, d):
    out = joins.control_group(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels").where("toxic = 1").select("doc_id"), ["doc_id"], 50, 7)
    return out.select("doc_id", ids.draw(7, F.col("doc_id").cast("string")).alias("k"))


@query("jon17_restrict", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jon17(spark, d):
    return joins.restrict(t(spark, d, "documents"), t(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id").select("doc_id")


@query("jon18_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def jon18(spark, d):
    n = joins.lookup(t(spark, d, "nation"), t(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.lookup(t(spark, d, "customer"), n, "c_nationkey").select("c_custkey", "n_name", "r_name")


@query("jon19_templates", "SELECT r_name || ': ' || t AS instruction FROM region, (SELECT DISTINCT p_type AS t FROM part)")
def jon19(spark, d):
    out = joins.expand_templates(t(spark, d, "region"), t(spark, d, "part").select("p_type").distinct())
    return out.select(F.concat_ws(": ", "r_name", "p_type").alias("instruction"))


@query(
    "jon20_reading_order",
    f"""WITH {BOXES}, p AS (SELECT a.doc, count(*) AS n FROM boxes a JOIN boxes b ON a.doc = b.doc AND a.mark_idx < b.mark_idx WHERE b.y2 + 12 < a.y1
  AND NOT (a.x1 >= b.x1 - 8 AND a.y1 >= b.y1 - 8 AND a.x2 <= b.x2 + 8 AND a.y2 <= b.y2 + 8) AND NOT (b.x1 >= a.x1 - 8 AND b.y1 >= a.y1 - 8 AND b.x2 <= a.x2 + 8 AND b.y2 <= a.y2 + 8) GROUP BY 1)
SELECT doc, coalesce(n, 0) AS inversions FROM (SELECT DISTINCT doc FROM boxes) LEFT JOIN p USING (doc)""".replace("boxes a JOIN boxes b", "mb a JOIN mb b").replace(
        ", p AS", ", mb AS (SELECT *, x1 * 1000 + idx AS mark_idx FROM boxes), p AS"
    ),
)
def jon20(spark, d):
    return joins.reading_inversions(boxes(spark, d).withColumn("idx", F.col("x1") * 1000 + F.col("idx")), "doc", "idx")


@query(
    "jon21_run_diff",
    """WITH a AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS v FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_linestatus = 'F' THEN l_returnflag ELSE '' END) AS v FROM lineitem WHERE l_discount > 0.01 GROUP BY 1, 2)
SELECT * FROM (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber, CASE WHEN b.l_orderkey IS NULL THEN 'only_a' WHEN a.l_orderkey IS NULL THEN 'only_b' WHEN a.v <> '' AND b.v = '' THEN 'emptied' WHEN a.v <> b.v THEN 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber) WHERE change IS NOT NULL""",
)
def jon21(spark, d):
    li, on = t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    a = li.where("l_quantity > 5").groupBy(*on).agg(F.min("l_returnflag").alias("v"))
    b = li.where("l_discount > 0.01").groupBy(*on).agg(F.max(F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).otherwise("")).alias("v"))
    return joins.run_diff(a, b, on, "v")


# ---- aggregates ----

_CER = r"levenshtein(trim(regexp_replace(gt, '\s+', ' ', 'g')), trim(regexp_replace(pred, '\s+', ' ', 'g'))) / greatest(length(trim(regexp_replace(gt, '\s+', ' ', 'g'))), length(trim(regexp_replace(pred, '\s+', ' ', 'g'))), 1)"
_DIG = "regexp_replace({}, '[^0-9]', '', 'g')"


@query("agg01_reason_counts", "SELECT 'short' AS reason, count(*) AS n FROM documents WHERE length(text) < 400 HAVING count(*) > 0 UNION ALL SELECT 'accent', count(*) FROM documents WHERE regexp_matches(text, '[éüñ]') HAVING count(*) > 0")
def agg01(spark, d):
    flags = F.array_compact(F.array(F.when(F.length("text") < 400, "short"), F.when(F.col("text").rlike("[éüñ]"), "accent")))
    return agg.reason_counts(t(spark, d, "documents").select(flags.alias("flags")), "flags")


@query(
    "agg02_score_by",
    rf"""WITH {READS}, s AS (SELECT model, tier, {_CER} AS cer, CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END AS e, CASE WHEN {_DIG.format('gt')} <> '' THEN CASE WHEN {_DIG.format('gt')} = {_DIG.format('pred')} THEN 1.0 ELSE 0.0 END END AS dg FROM reads)
SELECT model, tier, count(*) AS n, round(avg(cer), 6) AS cer, round(avg(e), 6) AS exact, round(avg(dg), 6) AS digit_accuracy FROM s GROUP BY GROUPING SETS ((model), (tier), ())""",
)
def agg02(spark, d):
    out = agg.score_by(reads(spark, d), "gt", "pred", ["model", "tier"])
    return out.select("model", "tier", "n", *[R6(c).alias(c) for c in ("cer", "exact", "digit_accuracy")])


@query(
    "agg03_micro_macro",
    f"WITH {SCORES}, g AS (SELECT model, task, count(*) AS n, sum(cer) AS s, avg(cer) AS m, count(*) FILTER (ok) AS e FROM scores GROUP BY 1, 2) SELECT model, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS micro, round(avg(m), 6) AS macro, CAST(sum(e) AS BIGINT) AS exact FROM g GROUP BY 1",
)
def agg03(spark, d):
    return agg.micro_macro(scores(spark, d), "model", "task", "cer", "ok").select("model", "n", R6("micro").alias("micro"), R6("macro").alias("macro"), "exact")


@query(
    "agg04_experiment",
    f"WITH {SCORES} SELECT model, count(*) AS n, round(median(cer), 6) AS median_cer, round(avg(cer), 6) AS mean_cer, count(*) FILTER (cer > 1) AS over_one, round(100 * avg(CASE WHEN cer = 0 THEN 1.0 ELSE 0.0 END), 6) AS exact_pct FROM scores WHERE doc NOT IN (SELECT doc FROM scores GROUP BY 1 HAVING avg(cer) > 1) GROUP BY 1",
)
def agg04(spark, d):
    s = scores(spark, d)
    drop = s.groupBy("doc").agg(agg.steady_mean("cer").alias("c")).where("c > 1").select("doc")
    out = agg.experiment_metrics(s, "model", "cer", drop, "doc")
    return out.select("model", "n", R6("median_cer").alias("median_cer"), R6("mean_cer").alias("mean_cer"), "over_one", R6("exact_pct").alias("exact_pct"))


_KIE = """k AS (SELECT l_orderkey AS doc, min(l_returnflag) AS doc_type, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS gs, count(*) AS gn, sum(l_discount * 10) AS ts, count(*) * 2 AS tn, count(*) AS gr, count(*) FILTER (l_quantity > 2) AS pr FROM lineitem GROUP BY 1)"""


def kie_rows(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(
        F.min("l_returnflag").alias("doc_type"), F.count_if(F.col("l_linestatus") == "F").cast("double").alias("general_score"), F.count("*").alias("general_n"), F.sum(F.col("l_discount") * 10).alias("table_score"),
        (F.count("*") * 2).alias("table_n"), F.count("*").alias("gt_rows"), F.count_if(F.col("l_quantity") > 2).alias("pred_rows"),
    )


# Exact on both sides: a sum of doubles hangs on their order, and one of these ratios is a tie at six places.
_EXACT = "CAST(sum(CAST({} AS DECIMAL(20, 6))) AS DOUBLE)"


@query(
    "agg05_kie_weighted",
    f"WITH {_KIE} SELECT doc_type, count(*) AS docs, round({_EXACT.format('gs')} / sum(gn), 6) AS general, round({_EXACT.format('ts')} / sum(tn), 6) AS \"table\", round({_EXACT.format('gs + ts')} / sum(gn + tn), 6) AS total, count(*) FILTER (gr <> pr) AS row_mismatch FROM k GROUP BY ROLLUP (doc_type)",
)
def agg05(spark, d):
    out = agg.kie_weighted(kie_rows(spark, d), "doc_type")
    return out.select("doc_type", "docs", *[R6(c).alias(c) for c in ("general", "table", "total")], "row_mismatch")


@query("agg06_kie_unweighted", f"WITH {_KIE} SELECT doc_type, count(*) AS docs, round(avg((gs + ts) / (gn + tn)), 6) AS accuracy FROM k GROUP BY 1")
def agg06(spark, d):
    return agg.kie_unweighted(kie_rows(spark, d), "doc_type").select("doc_type", "docs", R6("accuracy").alias("accuracy"))


_TIER = """CASE WHEN contains(lower(gt), lower(pred)) THEN 'exact' WHEN len(tk) > 0 AND h = len(tk) THEN 'all_tokens' WHEN h > 0 THEN 'partial' ELSE 'none' END"""


@query(
    "agg08_containment",
    rf"""WITH {READS}, k AS (SELECT *, list_filter(string_split_regex(lower(pred), '\s+'), lambda x: length(x) >= 2) AS tk FROM reads), h AS (SELECT *, len(list_filter(tk, lambda x: contains(lower(gt), x))) AS h FROM k)
SELECT tier AS field, {_TIER} AS found, count(*) AS n FROM h GROUP BY 1, 2""",
)
def agg08(spark, d):
    tier = agg.containment_tier(F.col("pred"), F.col("gt"))
    return reads(spark, d).groupBy(F.col("tier").alias("field"), tier.alias("found")).agg(F.count("*").alias("n"))


@query("agg10_outside_region", f"WITH {BOXES}, s AS (SELECT doc, min(y1) AS a, max(y2) AS b FROM boxes WHERE label <> 'A' GROUP BY 1) SELECT p.doc, count(*) FILTER (p.y2 < a - 5) AS above, count(*) FILTER (p.y1 > b + 5) AS below FROM preds p JOIN s ON s.doc = p.doc GROUP BY 1")
def agg10(spark, d):
    return agg.outside_region(preds(spark, d), boxes(spark, d).where("label <> 'A'"), "doc")


@query(
    "agg11_confusion",
    "WITH c AS (SELECT count(*) FILTER (f AND x) AS tp, count(*) FILTER (f AND NOT x) AS fp, count(*) FILTER (NOT f AND NOT x) AS tn, count(*) FILTER (NOT f AND x) AS fn FROM (SELECT l_quantity > 25 AS f, l_extendedprice > 30000 AS x FROM lineitem)) SELECT tp, fp, tn, fn, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round((tp + fp) / (tp + fp + tn + fn), 6) AS review_share FROM c",
)
def agg11(spark, d):
    out = agg.confusion(t(spark, d, "lineitem").selectExpr("l_quantity > 25 AS f", "l_extendedprice > 30000 AS x"), "f", "x")
    return out.select("tp", "fp", "tn", "fn", *[R6(c).alias(c) for c in ("recall", "precision", "review_share")])


_UNIT = "u AS (SELECT doc, model, avg(cer) AS cer FROM scores GROUP BY 1, 2)"


@query(
    "agg12_win_loss",
    f"WITH {SCORES}, {_UNIT}, b AS (SELECT doc, cer AS b FROM u WHERE model = 'click') SELECT model, count(*) FILTER (cer - b < -0.05) AS better, count(*) FILTER (cer - b > 0.05) AS worse, count(*) FILTER (abs(cer - b) <= 0.05) AS same FROM u JOIN b USING (doc) WHERE model <> 'click' GROUP BY 1",
)
def agg12(spark, d):
    u = scores(spark, d).groupBy("doc", "model").agg(agg.steady_mean("cer").alias("cer"))
    return agg.win_loss(u, "doc", "model", "cer", "click", 0.05)


@query("agg13_arm_pivot", f"WITH {SCORES} SELECT task, count(*) FILTER (ok AND model = 'click') AS click_ok, count(*) FILTER (model = 'click') AS click_n, count(*) FILTER (ok AND model = 'error') AS error_ok, count(*) FILTER (model = 'error') AS error_n FROM scores GROUP BY 1")
def agg13(spark, d):
    return agg.arm_pivot(scores(spark, d), "task", "model", "ok", ["click", "error"])


@query(
    "agg14_length_profile",
    "WITH r AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS c FROM documents) SELECT CAST(min(n) FILTER (i = CAST(floor(c * 0.1) AS BIGINT)) AS BIGINT) AS p10, CAST(min(n) FILTER (i = CAST(floor(c * 0.5) AS BIGINT)) AS BIGINT) AS p50, CAST(min(n) FILTER (i = CAST(floor(c * 0.9) AS BIGINT)) AS BIGINT) AS p90, CAST(max(n) AS BIGINT) AS most FROM r",
)
def agg14(spark, d):
    n = t(spark, d, "documents").select(F.length("text").cast("bigint").alias("n"))
    return agg.at_index(n, "n", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "most": 1.0})


@query("agg15_token_budget", "SELECT " + "".join(f"CAST(any_value(x) FILTER (i = least(c - 1, c * {q} // 100)) AS BIGINT) AS p{q}, " for q in (50, 90, 95, 99, 100)) + "count(*) AS n, count(*) FILTER (x > 1024) AS over, CAST(sum(greatest(x - 1024, 0)) AS BIGINT) AS lost, max(x) AS most, CAST(ceil(max(x) / 1024) * 1024 AS BIGINT) AS next_1024 FROM (SELECT *, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS c FROM (SELECT length(text) // 3 AS x FROM conversations))")
def agg15(spark, d):
    x = t(spark, d, "conversations").select(F.floor(F.length("text") / 3).alias("x"))
    return agg.token_budget(x, "x", 1024)


@query(
    "agg17_funnel",
    """WITH r AS (SELECT CASE WHEN length(text) < 300 THEN 'short' WHEN lang = 'fr' THEN 'french' WHEN length(text) > 8000 THEN 'long' END AS reason FROM documents), c AS (SELECT reason, count(*) AS removed FROM r WHERE reason IS NOT NULL GROUP BY 1), s AS (SELECT CASE reason WHEN 'short' THEN 1 WHEN 'french' THEN 2 ELSE 3 END AS step, * FROM c)
SELECT step, reason, removed, CAST((SELECT count(*) FROM documents) - sum(removed) OVER (ORDER BY step) AS BIGINT) AS "left" FROM s""",
)
def agg17(spark, d):
    reason = F.when(F.length("text") < 300, "short").when(F.col("lang") == "fr", "french").when(F.length("text") > 8000, "long")
    return agg.funnel(t(spark, d, "documents").select(reason.alias("reason")), "reason", ["short", "french", "long"])


@query("agg18_histogram", "SELECT CAST(floor(length(text) / 500) AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY 1")
def agg18(spark, d):
    return agg.histogram(t(spark, d, "documents").select(F.length("text").alias("n")), "n", 500)


@query("agg19_crosstab", "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY 1")
def agg19(spark, d):
    return agg.crosstab(t(spark, d, "documents"), "source", "lang", ["de", "en", "es", "fr"])


@query("agg20_provenance", "SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS items FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg20(spark, d):
    return agg.provenance(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_partkey")


@query("agg21_registry", "SELECT p_brand, p_type, count(*) AS sample_count, min(p_size) AS size FROM part GROUP BY 1, 2")
def agg21(spark, d):
    return agg.registry(t(spark, d, "part").withColumnRenamed("p_size", "size"), ["p_brand", "p_type"], ["size"])


@query("agg22_share", "SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1")
def agg22(spark, d):
    return agg.share(t(spark, d, "documents"), "source").select("source", "n", R6("share").alias("share"))


@query(
    "agg23_field_failures",
    "SELECT field, fails, worst FROM (SELECT p_brand AS field, count(*) AS fails, arg_min(p_name || p_partkey, (p_retailprice, p_name || p_partkey)) AS worst FROM part WHERE p_size < 30 GROUP BY 1) ORDER BY fails DESC, field LIMIT 25",
)
def agg23(spark, d):
    p = t(spark, d, "part").where("p_size < 30").select(F.concat(F.lit("row"), F.col("p_size").cast("string"), F.lit("."), "p_brand").alias("field"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("example"), "p_retailprice")
    return agg.field_failures(p, "field", "p_retailprice", "example")


@query(
    "agg25_usage_cost",
    "WITH u AS (SELECT event_type AS model, user_id AS i, CAST(floor(value) AS BIGINT) AS o FROM events), p AS (SELECT event_type AS model, 2.5 AS a, 10.0 AS b FROM events GROUP BY 1 HAVING avg(value) > 10) SELECT model, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, count(*) AS requests, round(CAST(any_value((sum(i) * a + sum(o) * b)) AS DOUBLE) / 1e6, 6) AS cost FROM u LEFT JOIN p USING (model) GROUP BY 1".replace(
        "any_value((sum(i) * a + sum(o) * b))", "sum(i) * any_value(a) + sum(o) * any_value(b)"
    ),
)
def agg25(spark, d):
    e = t(spark, d, "events")
    usage = e.select(F.col("event_type").alias("model"), F.col("user_id").alias("input_tokens"), F.floor("value").alias("output_tokens"))
    prices = e.groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("v")).where("v > 10").select("model", F.lit(2.5).alias("input_price"), F.lit(10.0).alias("output_price"))
    return agg.usage_cost(usage, prices).withColumn("cost", R6("cost"))


@query("agg26_term_verdicts", "SELECT CASE WHEN r AND w THEN 'mixed' WHEN r THEN 'correct' WHEN w THEN 'same_error' ELSE 'missing' END AS verdict, count(*) AS n FROM (SELECT contains(text, ' the ') AS r, contains(text, ' der ') AS w FROM documents) GROUP BY 1")
def agg26(spark, d):
    v = agg.term_verdict(F.col("text"), F.lit(" the "), F.lit(" der "))
    return t(spark, d, "documents").groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "agg27_corrections",
    "SELECT CASE WHEN b <> x AND a = x THEN 'repaired' WHEN b = x AND a <> x THEN 'broken' WHEN b <> x AND a <> x THEN 'missed' ELSE 'untouched' END AS outcome, count(*) AS n FROM (SELECT l_partkey // 100 AS x, l_suppkey // 5 AS b, l_partkey // 100 - CAST(l_discount > 0.05 AS INT) AS a FROM lineitem) GROUP BY 1",
)
def agg27(spark, d):
    li = t(spark, d, "lineitem").selectExpr("l_partkey div 100 AS x", "l_suppkey div 5 AS b", "l_partkey div 100 - CAST(l_discount > 0.05 AS INT) AS a")
    return agg.correction_outcomes(li, "b", "a", "x")


@query("agg28_sweep", f"WITH {SCORES} SELECT model, task, count(*) AS n, count(*) FILTER (ok) AS exact, round(avg(cer), 6) AS cer FROM scores GROUP BY GROUPING SETS ((model, task), (model))")
def agg28(spark, d):
    return agg.sweep(scores(spark, d), "model", "task", "cer", "ok").withColumn("cer", R6("cer"))


@query("agg29_pass_rate", "SELECT source, count(*) AS docs, count(*) FILTER (quality = 1) AS passed, round(avg(quality), 6) AS ratio FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def agg29(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").withColumn("passed", F.col("quality") == 1)
    return agg.pass_rate(x, "source", "passed").withColumn("ratio", R6("ratio"))


@query("agg30_doc_coverage")
def agg30(spark, d):
    return agg.doc_coverage(reads(spark, d), "model", "gt", "pred").withColumn("coverage", R6("coverage"))


@query("agg31_confidence", "SELECT l_returnflag = 'R' AS correct, count(*) AS n, round(avg(-l_discount), 6) AS mean, round(median(-l_discount), 6) AS median, min(-l_discount) AS least FROM lineitem GROUP BY 1")
def agg31(spark, d):
    x = t(spark, d, "lineitem").selectExpr("l_returnflag = 'R' AS correct", "-l_discount AS logprob")
    return agg.confidence_split(x, "correct", "logprob").withColumns({"mean": R6("mean"), "median": R6("median")})


@query("agg32_doc_wins", f"WITH {SCORES}, w AS (SELECT doc, model, count(*) FILTER (ok) AS wins FROM scores GROUP BY 1, 2) SELECT doc, model, wins, wins = max(wins) OVER (PARTITION BY doc) AND wins > 0 AS top FROM w")
def agg32(spark, d):
    return agg.doc_wins(scores(spark, d), "doc", "model", "ok")


@query("agg33_loss_buckets", "SELECT CAST(floor(event_id / 100) AS BIGINT) AS bucket, max(event_id) AS step, round(avg(value), 6) AS loss FROM events GROUP BY 1")
def agg33(spark, d):
    return agg.loss_buckets(t(spark, d, "events"), "event_id", "value").withColumn("loss", R6("loss"))


@query(
    "agg34_movement",
    f"""WITH {SCORES}, m AS (SELECT doc, task, avg(cer) FILTER (model = 'click') AS b, avg(cer) FILTER (model = 'error') AS a FROM scores GROUP BY 1, 2), g AS (SELECT task, CASE WHEN task = 'table' THEN a - b ELSE b - a END AS g, CASE WHEN task = 'table' THEN 0.1 ELSE 0.05 END AS e FROM m)
SELECT task, count(*) FILTER (g > e) AS better, count(*) FILTER (abs(g) <= e) AS same, count(*) FILTER (g < -e) AS worse FROM g GROUP BY 1""",
)
def agg34(spark, d):
    m = scores(spark, d).groupBy("doc", "task").agg(agg.steady_mean(F.when(F.col("model") == "click", F.col("cer"))).alias("b"), agg.steady_mean(F.when(F.col("model") == "error", F.col("cer"))).alias("a"))
    return agg.movement(m, "b", "a", "task", {"text": 0.05, "table": 0.1})


@query(
    "agg36_failure_matrix",
    f"WITH {READS} SELECT k AS kind, count(*) FILTER (model = 'Brand#1') AS \"Brand#1\", count(*) FILTER (model = 'Brand#2') AS \"Brand#2\" FROM (SELECT model, CASE WHEN trim(pred) = '' THEN 'empty' WHEN length(trim(pred)) > greatest(60, length(gt) * 3) THEN 'runaway' END AS k FROM reads) WHERE k IS NOT NULL GROUP BY 1",
)
def agg36(spark, d):
    r = reads(spark, d).withColumn("kind", rules.failure_type(F.col("gt"), F.col("pred")))
    return agg.failure_matrix(r, "kind", "model", ["Brand#1", "Brand#2"])


# ---- windows ----


@query("win01_reading_order", f"WITH {BOXES} SELECT doc, idx, row_number() OVER (PARTITION BY doc ORDER BY y1, x1, idx) - 1 AS \"order\" FROM boxes")
def win01(spark, d):
    return win.reading_order(boxes(spark, d), "doc", "y1", "x1", "idx").select("doc", "idx", "order")


# Boxes of a page one after another by (y1, x1, idx), with the top of the line they are in.
_GROUPED = """m AS (SELECT doc, greatest(8, 0.6 * median(y2 - y1)) AS tol FROM boxes GROUP BY doc),
o AS (SELECT boxes.*, tol, row_number() OVER (PARTITION BY doc ORDER BY y1, x1, idx) AS k FROM boxes JOIN m USING (doc)),
grouped AS (
  SELECT doc, idx, k, y1 AS top, 0 AS line FROM o WHERE k = 1
  UNION ALL
  SELECT o.doc, o.idx, o.k, CASE WHEN o.y1 - top > tol THEN o.y1 ELSE top END, CASE WHEN o.y1 - top > tol THEN line + 1 ELSE line END FROM grouped JOIN o ON o.doc = grouped.doc AND o.k = grouped.k + 1)"""


@query("win02_line_group", f"WITH RECURSIVE {BOXES}, {_GROUPED} SELECT doc, idx, line FROM grouped")
def win02(spark, d):
    return win.line_group(boxes(spark, d), "doc", "idx")


@query("win03_one_per_group", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def win03(spark, d):
    return win.one_per_group(t(spark, d, "documents").withColumn("minus", -F.col("n_chars")), "source", ["minus", "doc_id"]).select("source", "doc_id")


@query(
    "win04_rank_agreement",
    f"WITH {SCORES}, m AS (SELECT model, task, round(avg(cer), 6) AS c FROM scores GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY c DESC) AS r FROM m) SELECT a.model, a.r AS rank_0, b.r AS rank_1, a.r = b.r AS agree FROM r a JOIN r b ON a.model = b.model WHERE a.task = 'text' AND b.task = 'table'",
)
def win04(spark, d):
    m = scores(spark, d).groupBy("model", "task").agg(R6(F.avg("cer")).alias("c"))
    return win.rank_agreement(m, "model", "task", "c", ("text", "table"))


@query(
    "win05_best_per_slot",
    "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) SELECT p_brand, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY r) AS candidates, min(CAST(p_partkey AS VARCHAR)) FILTER (r = 1) AS best FROM r WHERE r <= 3 GROUP BY 1",
)
def win05(spark, d):
    return win.best_per_slot(t(spark, d, "part"), "p_brand", "p_partkey", "p_retailprice", lower=False)


# Rows of a chunk of the prefix scans: few, so that the small tables have several for a key.
CHUNK = 300


@query("win06_moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS moving FROM events")
def win06(spark, d):
    return win.moving_average(t(spark, d, "events"), "event_type", ["ts", "event_id"], "value", 5, CHUNK).select("event_id", R6("moving").alias("moving"))


@query("win07_running_total", "SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events")
def win07(spark, d):
    return win.running_total(t(spark, d, "events"), "event_type", ["ts", "event_id"], "user_id", CHUNK).select("event_id", "running")


@query(
    "win08_forward_fill",
    "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v_filled FROM (SELECT *, CASE WHEN event_type = 'error' THEN value END AS v FROM events)",
)
def win08(spark, d):
    e = t(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "error", F.col("value")))
    return win.forward_fill(e, "user_id", ["ts", "event_id"], "v").select("event_id", "v_filled")


@query(
    "win09_quantile_pick",
    "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c FROM documents) SELECT lang, doc_id FROM r WHERE i IN (c * 1 // 4, c * 2 // 4, c * 3 // 4)",
)
def win09(spark, d):
    return win.quantile_pick(t(spark, d, "documents"), "lang", ["n_chars", "doc_id"], 3, CHUNK).select("lang", "doc_id")


@query("win10_bands", "SELECT CAST(CASE WHEN value >= 80 THEN 80.0 WHEN value >= 60 THEN 60.0 WHEN value >= 40 THEN 40.0 WHEN value >= 20 THEN 20.0 ELSE -1.0 END AS DOUBLE) AS band, count(*) AS n FROM events GROUP BY 1")
def win10(spark, d):
    return win.bands(t(spark, d, "events"), "value", [80, 60, 40, 20])


@query(
    "win11_vs_baseline",
    f"WITH {SCORES}, m AS (SELECT model, round(avg(cer), 6) AS c FROM scores GROUP BY 1), b AS (SELECT c AS b FROM m WHERE model = 'click') SELECT model, round(c - b, 6) AS delta, c - b < 0 AS better FROM m, b",
)
def win11(spark, d):
    m = scores(spark, d).groupBy("model").agg(R6(F.avg("cer")).alias("c"))
    return win.vs_baseline(m, "model", "c", "click", higher_better=False).select("model", R6("delta").alias("delta"), "better")


# ---- sampling ----


@query(
    "top01_structure",
    r"""WITH s AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?m)^\|.*\|') OR contains(lower(html), '<table') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(html, '\$.+?\$|\\\(|\\begin\{(?:equation|align)') THEN 2 ELSE 0 END
 + CASE WHEN len(list_distinct(regexp_extract_all(html, '(?m)^(#{1,6})\s', 1))) >= 2 THEN 2 WHEN len(regexp_extract_all(html, '(?m)^(#{1,6})\s', 1)) > 0 THEN 1 ELSE 0 END + CASE WHEN length(html) > 800 THEN 1 ELSE 0 END AS structure FROM pages)
SELECT page_id, structure FROM s WHERE structure > 0 ORDER BY structure DESC, page_id LIMIT 100""",
)
def top01(spark, d):
    return sampling.topk_structure(t(spark, d, "pages"), "html", "page_id", 100).select("page_id", "structure")


@query(
    "top02_table_complexity",
    f"WITH {LINES}, n AS (SELECT l_orderkey AS doc, count(*) AS n FROM lines GROUP BY 1) SELECT doc, CAST(n * 2 + n + 1 + 1 + 3 * (n + 1) AS BIGINT) - n + n AS complexity FROM n WHERE n * 2 >= 12 AND n + 1 >= 4 ORDER BY complexity DESC, doc LIMIT 100".replace(
        "CAST(n * 2 + n + 1 + 1 + 3 * (n + 1) AS BIGINT) - n + n", "CAST(n * 2 + (n + 1) + 3 * (n + 1) AS BIGINT)"
    ),
)
def top02(spark, d):
    return sampling.topk_table_complexity(html_tables(spark, d), "html", "doc", 100).select("doc", F.col("complexity").cast("bigint").alias("complexity"))


@query(
    "top03_bucket_quota",
    """WITH b AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 800 THEN 'mid' ELSE 'long' END AS bucket FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('0|' || id), id) AS r, CASE bucket WHEN 'short' THEN 10 WHEN 'mid' THEN 95 ELSE 95 END AS q, CASE bucket WHEN 'long' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END AS turn FROM b)
SELECT id, bucket FROM r ORDER BY CAST(r > q AS INT), turn, r LIMIT 200""",
)
def top03(spark, d):
    c = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return sampling.bucket_quota(c, "text", "id", 200).select("id", "bucket")


@query("top04_cap_per_group", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('3|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def top04(spark, d):
    return sampling.cap_per_group(t(spark, d, "documents"), "source", "doc_id", 5, 3).select("source", "doc_id")


@query(
    "top05_stratified_split",
    """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('0|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels), s AS (SELECT *, floor(round(n * 0.8, 9)) AS a, floor(round(n * 0.1, 9)) AS b FROM r)
SELECT doc_id, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'val' ELSE 'test' END AS split FROM s""",
)
def top05(spark, d):
    return sampling.stratified_split(t(spark, d, "labels"), "quality", "doc_id").select("doc_id", "split")


@query(
    "top06_group_split",
    """WITH g AS (SELECT conv_id, row_number() OVER (ORDER BY md5('0|' || conv_id), conv_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)), s AS (SELECT *, greatest(1, floor(round(n * 0.1, 9))) AS a FROM g)
SELECT c.conv_id, c.turn, CASE WHEN r < a THEN 'test' WHEN r < 2 * a THEN 'val' ELSE 'train' END AS split FROM conversations c JOIN s USING (conv_id)""",
)
def top06(spark, d):
    return sampling.group_split(t(spark, d, "conversations"), "conv_id").select("conv_id", "turn", "split")


_UNIT01 = "CAST(('0x' || substr(md5('{}|' || {}), 1, 8)) AS BIGINT) / 4294967295"


@query("top07_hash_split", f"SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {_UNIT01.format(0, 'doc_id')} AS u FROM documents)")
def top07(spark, d):
    return sampling.hash_split(t(spark, d, "documents"), "doc_id").select("doc_id", "split")


@query("top08_pick_variant", "SELECT doc_id, CAST(('0x' || substr(md5(doc_id || '|' || lang || '|' || source), 1, 8)) AS BIGINT) % 5 AS variant FROM documents")
def top08(spark, d):
    return t(spark, d, "documents").select("doc_id", ids.pick_variant(F.col("doc_id"), F.col("lang"), F.col("source"), 5).alias("variant"))


@query(
    "top09_random_split",
    "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('1|' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r < greatest(10, floor(round(n * 0.05, 9))) THEN 'val' ELSE 'train' END AS split FROM r",
)
def top09(spark, d):
    return sampling.random_split(t(spark, d, "documents"), "doc_id", 0.05, 10, 1).select("doc_id", "split")


@query("top10_oversample", "SELECT doc_id, unnest([1, 2, 3]) AS copy FROM labels WHERE quality = 0")
def top10(spark, d):
    return sampling.oversample(t(spark, d, "labels").where("quality = 0"), 3).select("doc_id", "copy")


@query(
    "top11_balance",
    """WITH h AS (SELECT doc_id FROM labels WHERE quality = 0), c AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS n FROM labels WHERE quality = 1)
SELECT doc_id FROM h UNION ALL SELECT doc_id FROM c WHERE r < least(n, greatest(n // 2, floor(round((SELECT count(*) FROM h) * 0.65 / 0.35, 9))))""",
)
def top11(spark, d):
    return sampling.balance(t(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("hard")), "hard", "doc_id").select("doc_id")


@query(
    "top12_fill_to_target",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5('0|' || doc_id), doc_id LIMIT (SELECT CAST(count(*) // 4 AS BIGINT) FROM labels)",
)
def top12(spark, d):
    labels = t(spark, d, "labels").select("doc_id")
    n = labels.count()
    return sampling.fill_to_target(labels, t(spark, d, "documents").select("doc_id"), "doc_id", n + n // 4)


@query("top13_limit_per", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 20")
def top13(spark, d):
    return sampling.limit_per(t(spark, d, "events"), "event_type", 20, ["ts", "event_id"]).select("event_type", "event_id")


@query("top14_k_per_group", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('9|' || c_custkey), c_custkey) AS r FROM customer) WHERE r <= 7")
def top14(spark, d):
    return sampling.k_per_group(t(spark, d, "customer"), "c_mktsegment", "c_custkey", 7, 9).select("c_mktsegment", "c_custkey")


@query(
    "top15_worklist",
    r"""WITH c AS (SELECT doc_id, text, regexp_extract_all(text, '\|([^|\n]*)', 1) AS c, len(regexp_extract_all(text, '[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+원')) AS m FROM documents),
s AS (SELECT doc_id, CASE WHEN len(c) >= 6 THEN len(list_filter(c, lambda x: regexp_matches(trim(x), '^-*$'))) / len(c) ELSE 0 END AS e, m, length(text) AS n, NOT regexp_matches(text, '[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}') AS nd FROM c),
r AS (SELECT doc_id, round(least(100.0, e * 60 + CASE WHEN m = 0 THEN 25 WHEN m < 3 THEN 10 ELSE 0 END + CASE WHEN nd THEN 8 ELSE 0 END + CASE WHEN n < 200 THEN 12 ELSE 0 END), 6) AS score FROM s) SELECT * FROM r WHERE score >= 20""",
)
def top15(spark, d):
    return sampling.worklist(t(spark, d, "documents"), "text").select("doc_id", R6("score").alias("score"))


@query("top16_bottom_n", f"WITH {_KIE} SELECT doc, round(gs / gn, 6) AS accuracy FROM k WHERE gs / gn < 0.7 ORDER BY gs / gn, doc LIMIT 100")
def top16(spark, d):
    k = kie_rows(spark, d).select("doc", (F.col("general_score") / F.col("general_n")).alias("accuracy"))
    return sampling.bottom_n(k, "accuracy", "doc", 100).withColumn("accuracy", R6("accuracy"))


@query("top17_threshold_sweep", "SELECT x AS threshold, count(*) FILTER (l_discount * 10 >= x) AS kept, count(*) FILTER (l_discount * 10 < x) AS dropped FROM lineitem, (SELECT unnest([0.25, 0.55, 0.85]) AS x) GROUP BY 1".replace("[0.25", "[CAST(0.25 AS DOUBLE)"))
def top17(spark, d):
    return sampling.threshold_sweep(t(spark, d, "lineitem").selectExpr("l_discount * 10 AS s"), "s", [0.25, 0.55, 0.85])


@query("top18_id_range", "SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#0000') AND c_name <= 'Customer#000000999'")
def top18(spark, d):
    return sampling.id_range(t(spark, d, "customer"), "c_name", "Customer#0000", "Customer#000000999").select("c_custkey")


# ---- set operations ----


@query("set01_union", "SELECT 'customer' AS source, c_custkey AS id, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, NULL FROM supplier")
def set01(spark, d):
    return setops.union_tagged({"customer": t(spark, d, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS segment"), "supplier": t(spark, d, "supplier").selectExpr("s_suppkey AS id")}).select("source", "id", "segment")


@query("set03_leakage", "SELECT conv_id FROM conversations WHERE role = 'system' INTERSECT SELECT conv_id FROM conversations WHERE role = 'assistant' AND length(text) > 500")
def set03(spark, d):
    c = t(spark, d, "conversations")
    return setops.leakage(c.where("role = 'system'"), c.where("role = 'assistant' and length(text) > 500"), "conv_id")


@query("set04_accumulate", "SELECT DISTINCT l_suppkey AS name FROM lineitem WHERE l_quantity > 49 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def set04(spark, d):
    new = t(spark, d, "lineitem").where("l_quantity > 49").selectExpr("l_suppkey AS name")
    return setops.accumulate(t(spark, d, "supplier").where("s_acctbal > 5000").selectExpr("s_suppkey AS name"), new, "name")


@query("set05_dedup_first", "SELECT min(doc_id) AS doc_id, count(*) - 1 AS copies FROM documents GROUP BY md5(text)")
def set05(spark, d):
    return setops.dedup_first(t(spark, d, "documents").select("doc_id", F.md5("text").alias("f")), "f", "doc_id").select("doc_id", "copies")


@query(
    "set07_scoped_fix",
    "WITH c AS (SELECT doc_id FROM labels WHERE quality = 0) SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN 0 ELSE (length(text) - length(replace(text, 'the', ''))) // 3 END AS hits, md5(CASE WHEN c.doc_id IS NULL THEN text ELSE replace(text, 'the', 'THE') END) AS h FROM documents d LEFT JOIN c USING (doc_id)",
)
def set07(spark, d):
    fixes = t(spark, d, "labels").where("quality = 0").select("doc_id", F.lit("the").alias("old"), F.lit("THE").alias("new"))
    return setops.scoped_fix(t(spark, d, "documents").select("doc_id", "text"), fixes, "doc_id", "text").select("doc_id", "hits", F.md5("text").alias("h"))


@query("set08_cell_fix", f"WITH {LINES} SELECT l_orderkey AS doc, count(*) FILTER (l_returnflag = 'R') AS hits FROM lines GROUP BY 1")
def set08(spark, d):
    return setops.cell_fix(html_tables(spark, d), "html", {"R": "returned"}).select("doc", F.col("hits").cast("bigint").alias("hits"))


@query(
    "set09_review_blocks",
    f"""WITH {BOXES}, a AS (SELECT doc, idx, CASE label WHEN 'R' THEN 'remove' WHEN 'A' THEN 'edit' ELSE 'keep' END AS action FROM boxes), k AS (SELECT doc, idx, y1, x1, CASE WHEN label = 'A' THEN 'edited' ELSE mark END AS text FROM boxes WHERE label <> 'R')
SELECT doc, idx, text, row_number() OVER (PARTITION BY doc ORDER BY y1, x1, idx) - 1 AS "order" FROM k""",
)
def set09(spark, d):
    b = boxes(spark, d)
    blocks = b.selectExpr("doc", "idx", "y1 AS y", "x1 AS x", "mark AS text")
    acts = b.selectExpr("doc", "idx", "CASE label WHEN 'R' THEN 'remove' WHEN 'A' THEN 'edit' ELSE 'keep' END AS action", "'edited' AS new_text", "y1 AS new_y", "x1 AS new_x")
    return setops.review_blocks(blocks, acts, "doc").select("doc", "idx", "text", "order")


_VERDICT = """v AS (SELECT id, gt, pred, tier, CASE WHEN tier = 'ECONOMY' THEN 'high' WHEN tier = 'PROMO' THEN 'mid' ELSE 'low' END AS grade, CASE WHEN tier = 'STANDARD' THEN 'parser' WHEN tier = 'SMALL' THEN 'other' WHEN tier = 'MEDIUM' THEN 'maybe' END AS verdict, CASE WHEN model < 'Brand#15' THEN 'fixed' END AS correct FROM reads)"""


@query(
    "set10_verdicts",
    f"""WITH {READS}, {_VERDICT} SELECT id, CASE WHEN verdict IS NULL AND grade = 'low' THEN 'waiting' WHEN verdict = 'other' AND correct IS NULL THEN 'no_correction' WHEN verdict = 'maybe' THEN 'unknown_verdict' ELSE 'gt' END AS state,
 CASE WHEN verdict IS NULL AND grade <> 'low' THEN pred WHEN verdict = 'parser' THEN gt WHEN verdict = 'other' AND correct IS NOT NULL THEN correct END AS label FROM v""",
)
def set10(spark, d):
    r = reads(spark, d)
    grade = F.when(F.col("tier") == "ECONOMY", "high").when(F.col("tier") == "PROMO", "mid").otherwise("low")
    c = r.select("id", grade.alias("grade"), F.lit(False).alias("parser_changed"), F.col("gt").alias("parser"), F.col("pred").alias("label"))
    verdict = F.when(F.col("tier") == "STANDARD", "parser").when(F.col("tier") == "SMALL", "other").when(F.col("tier") == "MEDIUM", "maybe")
    v = r.select("id", verdict.alias("verdict"), F.when(F.col("model") < "Brand#15", "fixed").alias("correct"))
    gt, blocked = setops.apply_verdicts(c, v, "id")
    return gt.select("id", F.lit("gt").alias("state"), "label").unionByName(blocked.select("id", F.col("reason").alias("state"), F.lit(None).cast("string").alias("label")))


@query(
    "set11_upsert",
    "SELECT c_custkey, 'c_mktsegment' AS col, c_mktsegment AS old, 'VIP' AS new FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_suppkey + 10000000, 'c_mktsegment', NULL, 'VIP' FROM supplier WHERE s_acctbal > 9000",
)
def set11(spark, d):
    log = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = t(spark, d, "customer").where("c_acctbal > 9000").select("c_custkey").union(t(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_suppkey") + 10000000))
    return setops.upsert(log, new.withColumn("c_mktsegment", F.lit("VIP")), "c_custkey")[1]


@query("set12_collect_since", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN 'updated' ELSE 'new' END AS state FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01 00:00:00'")
def set12(spark, d):
    known = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    import datetime

    return setops.collect_since(t(spark, d, "orders"), known, "o_orderkey", "o_orderdate", datetime.datetime(1997, 6, 1)).select("o_orderkey", "state")


# ---- reshaping and tables ----


@query("prj01_pages", "SELECT l_orderkey AS doc, 1000.0::DOUBLE AS width, 2000.0::DOUBLE AS height, count(*) AS n FROM lineitem GROUP BY 1")
def prj01(spark, d):
    pages, _ = reshape.pages(responses(spark, d), "doc", "body")
    return pages.select("doc", "width", "height", F.size("parsing_res_list").cast("bigint").alias("n"))


@query(
    "prj02_blocks",
    f"WITH {BOXES} SELECT doc, idx - 1 AS pos, CASE label WHEN 'A' THEN 'doc_title' WHEN 'R' THEN 'table' ELSE 'text' END AS label, 'part ' || l_suppkey AS content, CASE WHEN mark = 'F' THEN idx * 2 ELSE idx END AS order_key, x1, y2 FROM boxes",
)
def prj02(spark, d):
    pages, _ = reshape.pages(responses(spark, d), "doc", "body")
    return reshape.blocks(pages, "doc").select("doc", "pos", "label", "content", "order_key", F.col("bbox")[0].alias("x1"), F.col("bbox")[3].alias("y2"))


@query("prj03_boxes", f"WITH {BOXES} SELECT doc, idx - 1 AS pos, label, x1, y1, x2, y2 FROM boxes WHERE l_discount * 10 >= 0.45")
def prj03(spark, d):
    pages, _ = reshape.pages(responses(spark, d), "doc", "body")
    return reshape.boxes(pages, "doc", 0.45).select("doc", "pos", "label", "x1", "y1", "x2", "y2")


@query("prj05_fields_long", "SELECT o_orderkey AS doc_id, unnest(['status', 'priority', 'date']) AS field, unnest([o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d')]) AS value FROM orders")
def prj05(spark, d):
    return reshape.fields_long(kie_docs(spark, d), "doc_id", "fields")


@query("prj06_items_long", f"WITH {LINES} SELECT l_orderkey AS doc_id, idx - 1 AS idx, CAST(l_partkey AS VARCHAR) AS name, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount FROM lines JOIN orders ON o_orderkey = l_orderkey")
def prj06(spark, d):
    return reshape.items_long(kie_docs(spark, d), "doc_id", "items").select("doc_id", "idx", "name", "qty", "amount")


@query("prj08_union_bbox", f"WITH {BOXES} SELECT doc, label, min(x1 - 2) AS x1, min(y1) AS y1, max(x2 + 3) AS x2, max(y2) AS y2, string_agg(mark || idx, ' ' ORDER BY x1, idx) AS text FROM boxes GROUP BY 1, 2")
def prj08(spark, d):
    # Slanted quads of words; boxes of one label are a line.
    quads = boxes(spark, d).select("doc", "label", "x1", "idx", F.array(F.col("x1") - 2, "x2", F.col("x2") + 3, "x1").alias("x"), F.array("y1", "y1", "y2", "y2").alias("y"), F.concat("mark", F.col("idx").cast("string")).alias("word"))
    return geom.union_bbox(quads, ["doc", "label"], "x", "y", "word", ["x1", "idx"])


@query("prj09_unify_fields", "SELECT o_orderkey AS doc_id, 'order_state=' || o_orderstatus || ',urgency=' || o_orderpriority AS fields FROM orders")
def prj09(spark, d):
    alias = spark.createDataFrame([("status", "order_state"), ("priority", "urgency")], "key string, common string")
    out = reshape.unify_fields(kie_docs(spark, d), "doc_id", "fields", alias)
    return out.select("doc_id", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("fields"))


@query("prj10_get_field", "SELECT o_orderkey AS doc_id, o_orderstatus AS value FROM orders")
def prj10(spark, d):
    return kie_docs(spark, d).select("doc_id", reshape.get_field(F.col("fields"), ["missing", "status", "priority"]).alias("value"))


@query(
    "prj14_answers",
    "WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) SELECT conv_id, md5(max(text) FILTER (role = 'assistant' AND r = 1)) AS answer, md5(trim(max(text) FILTER (role = 'user' AND r = 1))) AS prompt FROM r GROUP BY 1",
)
def prj14(spark, d):
    m = reshape.messages(t(spark, d, "conversations"), "conv_id")
    return m.select("conv_id", F.md5(reshape.answer(F.col("messages"))).alias("answer"), F.md5(reshape.prompt(F.col("messages"))).alias("prompt"))


@query("prj15_reroot", "SELECT p_partkey, CASE split_part(path, '/', 1) WHEN 'red' THEN 'warm/' || path WHEN 'blue' THEN 'cold/' || path WHEN 'small' THEN path END AS new_path FROM (SELECT p_partkey, replace(p_name, ' ', '/') AS path FROM part)")
def prj15(spark, d):
    prefixes = spark.createDataFrame([("red", "warm"), ("blue", "cold"), ("small", "")], "root string, prefix string")
    p = t(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("/")).alias("path"))
    return reshape.reroot(p, "path", prefixes).select("p_partkey", "new_path")


@query("prj17_unpivot", f"WITH {READS} SELECT id, 'a' AS model, gt AS pred, 1.0::DOUBLE AS sec FROM reads UNION ALL SELECT id, 'b', pred, 2.0 FROM reads WHERE pred <> ''")
def prj17(spark, d):
    wide = reads(spark, d).select("id", F.struct(F.col("gt").alias("pred"), F.lit(1.0).alias("sec")).alias("a"), F.when(F.col("pred") != "", F.struct("pred", F.lit(2.0).alias("sec"))).alias("b"))
    return reshape.unpivot_models(wide, ["id"], {"a": "a", "b": "b"})


_CELLS = """UNION ALL SELECT l_orderkey, CAST(idx AS INT), {c}, {v} FROM lines"""


@query(
    "prj18_cells",
    f"""WITH {LINES}, o AS (SELECT DISTINCT l_orderkey AS doc FROM lines) SELECT doc, 0 AS "row", c AS col, x AS text FROM o, (SELECT unnest([0, 1, 2, 3]) AS c, unnest(['part', 'qty', '', 'flag']) AS x)
{_CELLS.format(c=0, v='CAST(l_partkey AS VARCHAR)')} {_CELLS.format(c=1, v='CAST(CAST(l_quantity AS INT) AS VARCHAR)')} {_CELLS.format(c=2, v="''")} {_CELLS.format(c=3, v='l_returnflag')}""",
)
def prj18(spark, d):
    return tables.cells(html_tables(spark, d), "doc", "html").select("doc", "row", "col", "text")


@query(
    "prj20_md_rows",
    f"WITH {LINES} SELECT l_orderkey AS doc, idx AS pos, CAST(l_partkey AS VARCHAR) AS name, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice) AS BIGINT) AS amount FROM lines",
)
def prj20(spark, d):
    line = F.format_string("| %s | %d | %,d |", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("bigint"), F.round("l_extendedprice").cast("bigint"))
    md = lines(spark, d).groupBy(F.col("l_orderkey").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("r")))).alias("a"))
    return tables.md_rows(md.select("doc", F.concat(F.lit("| name | qty | amount |\n"), F.array_join("a.r", "\n")).alias("text")), "doc", "text")


@query("prj21_extract_tables", f"WITH {CANON} SELECT doc, 2 AS n FROM canon")
def prj21(spark, d):
    h = html_tables(spark, d).select("doc", F.concat("html", F.lit("\ntext "), "html").alias("text"))
    return h.select("doc", F.size(tables.extract_all(F.col("text"))).alias("n"))


@query("sca01_canon", f"WITH {CANON} SELECT doc, md5(html) AS h FROM canon")
def sca01(spark, d):
    from docq.functions.text import canon

    return html_tables(spark, d).select("doc", F.md5(canon(F.col("html"))).alias("h"))


@query("sca02_compare_key", f"WITH {CANON} SELECT doc, md5(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', '', 'g')) AS h FROM canon")
def sca02(spark, d):
    from docq.functions.text import compare_key

    return html_tables(spark, d).select("doc", F.md5(compare_key(F.col("html"))).alias("h"))


@query("sca04_norm_key", "SELECT c_custkey, lower(regexp_replace(c_name || c_mktsegment, '[^0-9A-Za-z]', '', 'g')) AS k FROM customer")
def sca04(spark, d):
    from docq.functions.text import norm_key

    return t(spark, d, "customer").select("c_custkey", norm_key(F.concat("c_name", "c_mktsegment")).alias("k"))


@query(
    "sca06_html_to_md",
    f"""WITH {LINES} SELECT l_orderkey AS doc, md5('| part | qty |  | flag |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || l_partkey || ' | ' || CAST(l_quantity AS INT) || ' |  | ' || l_returnflag || ' |', chr(10) ORDER BY idx)) AS h FROM lines GROUP BY 1""",
)
def sca06(spark, d):
    return html_tables(spark, d).select("doc", F.md5(tables.html_to_md(F.col("html"))).alias("h"))


@query(
    "sca07_markdown",
    f"""WITH {BOXES}, p AS (SELECT doc, CASE WHEN mark = 'F' THEN idx * 2 ELSE idx END AS k, idx, CASE label WHEN 'A' THEN '# ' ELSE '' END || 'part ' || l_suppkey AS part FROM boxes) SELECT doc, md5(string_agg(part, chr(10) || chr(10) ORDER BY k, idx)) AS h FROM p GROUP BY 1""",
)
def sca07(spark, d):
    pages, _ = reshape.pages(responses(spark, d), "doc", "body")
    md = reshape.build_markdown(reshape.blocks(pages, "doc"), "doc", ("image",), ("doc_title",), ("paragraph_title",))
    return md.select("doc", F.md5("markdown").alias("h"))


@query("sca13_cer", f"WITH {READS} SELECT id, round({_CER}, 6) AS cer FROM reads")
def sca13(spark, d):
    return reads(spark, d).select("id", R6(metric.cer(F.col("gt"), F.col("pred"))).alias("cer"))


@query("sca14_cer_opcode")
def sca14(spark, d):
    return reads(spark, d).select("id", R6(metric.cer_opcode("gt", "pred")).alias("cer"), R6(metric.cer_ratio("gt", "pred")).alias("ratio"))


@query(
    "sca16_value_score",
    "SELECT o_orderkey, CASE WHEN abs(o_totalprice - floor(o_totalprice)) <= 1e-4 THEN 1.0::DOUBLE ELSE 0.0 END AS money, round(1 - levenshtein(lower(o_orderpriority), lower(o_orderstatus)) / greatest(length(o_orderpriority), length(o_orderstatus)), 6) AS words FROM orders",
)
def sca16(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", metric.value_score(F.floor("o_totalprice"), F.col("o_totalprice")).alias("money"), R6(metric.value_score(F.col("o_orderstatus"), F.col("o_orderpriority"))).alias("words"))


@query("sca17_area", f"WITH {BOXES} SELECT doc, idx, (x2 - x1) * (y2 - y1) AS area FROM boxes")
def sca17(spark, d):
    return boxes(spark, d).select("doc", "idx", geom.area(geom.box()).alias("area"))


@query("sca18_rescale", f"WITH {BOXES} SELECT doc, idx, least(x1 * 1.5, 1000) AS x1, least(y1 * 0.5, 300) AS y1, least(x2 * 1.5, 1000) AS x2, least(y2 * 0.5, 300) AS y2 FROM boxes")
def sca18(spark, d):
    b = geom.rescale(geom.box(), F.lit(1.5), F.lit(0.5), F.lit(1000.0), F.lit(300.0))
    return boxes(spark, d).select("doc", "idx", *[c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)])


@query(
    "sca19_pad_crop",
    f"WITH {BOXES}, p AS (SELECT *, greatest(8, (x2 - x1) * 0.05) AS px, greatest(8, (y2 - y1) * 0.05) AS py FROM boxes) SELECT doc, idx, CAST(trunc(greatest(0, x1 - px)) AS INT) AS x1, CAST(trunc(greatest(0, y1 - py)) AS INT) AS y1, CAST(trunc(least(900, x2 + px)) AS INT) AS x2, CAST(trunc(least(900, y2 + py)) AS INT) AS y2 FROM p",
)
def sca19(spark, d):
    b = geom.pad_crop(geom.box(), F.lit(900), F.lit(900), 0.05, 8)
    return boxes(spark, d).select("doc", "idx", *[c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)])


@query(
    "sca20_transposed",
    "SELECT p_partkey, abs(w / h - hh / ww) < 0.12 * greatest(1.0, w / h) AND NOT abs(w / h - ww / hh) < 0.3 AS transposed FROM (SELECT p_partkey, p_size * 20.0 AS w, p_retailprice AS h, p_retailprice + 20.0 AS ww, p_size * 20.0 + 10 AS hh FROM part)",
)
def sca20(spark, d):
    p = t(spark, d, "part").selectExpr("p_partkey", "CAST(p_size * 20.0 AS DOUBLE) AS w", "p_retailprice AS h", "p_retailprice + 20.0 AS ww", "CAST(p_size * 20.0 + 10 AS DOUBLE) AS hh")
    return p.select("p_partkey", geom.is_transposed(F.col("w"), F.col("h"), F.col("ww"), F.col("hh")).alias("transposed"))


@query("sca22_vision_tokens", "SELECT p_partkey, CAST(greatest(28.0, round_even(p_size * 50.0 / 28, 0) * 28) / 28 * greatest(28.0, round_even(floor(p_retailprice) / 28, 0) * 28) / 28 AS BIGINT) AS tokens FROM part")
def sca22(spark, d):
    p = t(spark, d, "part").selectExpr("p_partkey", "CAST(p_size * 50 AS DOUBLE) AS w", "floor(p_retailprice) * 1.0D AS h")
    return p.select("p_partkey", tokens.vision_tokens(F.col("w"), F.col("h"), 100_000_000).alias("tokens"))


@query(
    "sca26_verify_items",
    f"""WITH {LINES}, i AS (SELECT l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q FROM lines), s AS (SELECT l_orderkey, CAST(sum(c) AS BIGINT) AS total, bool_or((c // q) * q <> c) AS bad, count(*) AS n FROM i GROUP BY 1)
SELECT o_orderkey AS doc_id, array_to_string(list_filter([CASE WHEN n > 0 AND s.total <> CAST(round(o_totalprice * 100) AS BIGINT) THEN 'items_vs_total' END, CASE WHEN coalesce(s.total, 0) <> CAST(round(o_totalprice * 100) AS BIGINT) THEN 'subtotal_tax_vs_total' END, CASE WHEN bad THEN 'unit_qty_vs_amount' END], lambda x: x IS NOT NULL), ',') AS issues FROM orders LEFT JOIN s ON s.l_orderkey = o_orderkey""",
)
def sca26(spark, d):
    docs = kie_docs(spark, d).withColumn("tax", F.lit(0).cast("bigint"))
    return rules.verify_items(docs, "items", "item_total", "tax", "total").select("doc_id", F.array_join("issues", ",").alias("issues"))


@query("sca30_record_id", "SELECT doc_id, source || '#' || substr(sha1(source || '|' || doc_id || '|' || lang), 1, 8) AS id FROM documents")
def sca30(spark, d):
    return t(spark, d, "documents").select("doc_id", ids.record_id(F.col("source"), F.col("doc_id"), F.col("lang")).alias("id"))


@query(
    "sca31_failure_type",
    f"WITH {READS} SELECT id, CASE WHEN trim(pred) = '' THEN 'empty' WHEN length(trim(pred)) > greatest(60, length(gt) * 3) THEN 'runaway' END AS kind FROM reads",
)
def sca31(spark, d):
    return reads(spark, d).select("id", rules.failure_type(F.col("gt"), F.col("pred")).alias("kind"))


@query(
    "sca33_error_kind",
    rf"""WITH {READS}, k AS (SELECT id, trim(regexp_replace(gt, '\s+', ' ', 'g')) AS a, trim(regexp_replace(pred, '\s+', ' ', 'g')) AS b FROM reads), w AS (SELECT *, list_distinct(string_split(lower(a), ' ')) AS wa, list_distinct(string_split(lower(b), ' ')) AS wb FROM k)
SELECT id, CASE WHEN a = b THEN 'exact' WHEN lower(regexp_replace(a, '[^a-zA-Z0-9]', '', 'g')) = lower(regexp_replace(b, '[^a-zA-Z0-9]', '', 'g')) THEN 'notation' WHEN contains(b, a) THEN 'over_extraction' WHEN len(list_intersect(wa, wb)) / len(wa) >= 0.7 THEN 'vocabulary' ELSE 'misread' END AS kind FROM w""",
)
def sca33(spark, d):
    return reads(spark, d).select("id", rules.error_kind(F.col("gt"), F.col("pred")).alias("kind"))


@query(
    "udf01_teds",
    f"WITH {LINES} SELECT l_orderkey AS doc, round(1 - count(*) FILTER (l_returnflag = 'R') / (3 + 4 * (count(*) + 1)), 6) AS teds FROM lines GROUP BY 1",
)
def udf01(spark, d):
    # Trees cost far more than their bytes tell, by which adaptive execution would join
    # partitions; a hash, as a repartition on doc itself falls away after the grouping on it.
    n = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    h = html_tables(spark, d).repartition(n, F.xxhash64("doc"))
    return h.select("doc", R6(tables.teds("html", F.replace("html", F.lit("<TD>R<"), F.lit("<TD>Q<")))).alias("teds"))


# ---- sources and sinks as tables ----


@query("src05_yolo", "SELECT p_partkey, p_size AS cls, round(0.5 - p_size / 200.0, 6) AS x1, round(0.5 + p_size / 200.0, 6) AS x2 FROM part")
def src05(spark, d):
    line = F.format_string("%d 0.5 0.25 %.6f 0.125", F.col("p_size"), F.col("p_size") / 100.0)
    return io.parse_yolo(t(spark, d, "part").select("p_partkey", line.alias("value"))).select("p_partkey", "cls", "x1", "x2")


@query("src07_name_dims", "SELECT c_custkey, 'Customer' AS kind, substr(c_name, 10) AS number FROM customer")
def src07(spark, d):
    return io.parse_name_dims(t(spark, d, "customer"), "c_name", r"^(\w+)#([0-9]+)$", ["kind", "number"]).select("c_custkey", "kind", "number")


@query(
    "src08_eval_log",
    """WITH e AS (SELECT *, CASE WHEN event_type = 'view' THEN 'img' || event_id END AS i, CASE WHEN event_type = 'click' THEN event_id END AS a, CASE WHEN event_type NOT IN ('view', 'click') THEN value END AS s FROM events),
f AS (SELECT *, last_value(i IGNORE NULLS) OVER w AS image, last_value(a IGNORE NULLS) OVER w AS arm_at, last_value(CASE WHEN s IS NOT NULL THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, image, 'arm' || arm_at AS arm, s AS score FROM f WHERE s IS NOT NULL AND arm_at IS NOT NULL AND (before IS NULL OR arm_at > before)""",
)
def src08(spark, d):
    e, i = t(spark, d, "events"), F.col("event_id").cast("string")
    value = F.when(F.col("event_type") == "view", F.concat(F.lit("image: img"), i)).when(F.col("event_type") == "click", F.concat(F.lit("[arm"), i, F.lit("]"))).otherwise(F.concat(F.lit("score="), F.col("value").cast("string")))
    log = e.select("user_id", "event_id", value.alias("value"))
    return io.parse_eval_log(log, "user_id", "event_id", "value", r"^image: (\S+)", r"^\[(arm[0-9]+)\]", r"^score=([0-9.eE-]+)")


@query("src09_train_log", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'eval' ELSE 'train' END AS kind, value AS loss, CAST(user_id AS DOUBLE) AS epoch FROM events")
def src09(spark, d):
    name = F.when(F.col("event_type") == "error", "eval_loss").otherwise("loss")
    line = F.concat(F.lit("{'"), name, F.lit("': "), F.col("value").cast("string"), F.lit(", 'epoch': "), F.col("user_id").cast("string"), F.lit("}"))
    return io.parse_train_log(t(spark, d, "events").select("event_id", line.alias("value")), "value").select("event_id", "kind", "loss", "epoch")


@query("src10_progress", "SELECT event_id, CAST(user_id AS INT) AS done, 500 AS total, value AS sec_per_it FROM events")
def src10(spark, d):
    line = F.concat(F.lit("1/500 [00:01<08:19, 1.0s/it] "), F.col("user_id").cast("string"), F.lit("/500 [00:10<01:00, "), F.col("value").cast("string"), F.lit("s/it]"))
    return t(spark, d, "events").select("event_id", io.parse_progress(line).alias("p")).select("event_id", "p.*")


@query("src11_profile", " UNION ALL ".join(f"SELECT '{c}' AS name, '{k}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct, CAST(min_by({c}, event_id) AS VARCHAR) AS first FROM events" for c, k in (("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string"))))
def src11(spark, d):
    return io.profile_table(t(spark, d, "events").drop("ts"), ["event_id"])


@query(
    "snk04_yolo",
    f"""WITH {BOXES}, c AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS cls FROM boxes GROUP BY 1)
SELECT doc, printf('%d %.6f %.6f %.6f %.6f', cls, (x1 + x2) / 2 / 1000.0, (y1 + y2) / 2 / 2000.0, (x2 - x1) / 1000.0, (y2 - y1) / 2000.0) AS line FROM boxes JOIN c USING (label)""",
)
def snk04(spark, d):
    return io.to_yolo(boxes(spark, d).withColumns({"w": F.lit(1000.0), "h": F.lit(2000.0)}), "doc", "label")[0]


@query("snk05_manifest", "SELECT o_orderkey AS doc_id, 4 AS n_fields, CAST(count(l_orderkey) AS INT) AS n_items, false OR any_value(o_totalprice) > 100000 AS passed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def snk05(spark, d):
    return io.write_manifest(kie_docs(spark, d).withColumn("passed", F.col("total") > 10000000))


@query("snk07_ranked", "SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, p_partkey, p_retailprice, p_brand || ' / ' || p_type AS reasons FROM part ORDER BY rank LIMIT 30")
def snk07(spark, d):
    return io.ranked(t(spark, d, "part").withColumn("r", F.array("p_brand", "p_type")), "p_retailprice", "p_partkey", "r", 30)


# ---- jobs ----


@query(
    "job06_consensus",
    rf"""WITH {READS}, k AS (SELECT id, regexp_replace(regexp_replace(gt, '\s+', '', 'g'), '^[oO0*\-\s]+', '') AS p, regexp_replace(regexp_replace(pred, '\s+', '', 'g'), '^[oO0*\-\s]+', '') AS a, regexp_replace(regexp_replace(lower(gt), '\s+', '', 'g'), '^[oO0*\-\s]+', '') AS b FROM reads),
s AS (SELECT id, levenshtein(p, a) / greatest(length(p), length(a), 1) <= 0.02 AS pa, levenshtein(p, b) / greatest(length(p), length(b), 1) <= 0.02 AS pb, levenshtein(a, b) / greatest(length(a), length(b), 1) <= 0.02 AS ab FROM k)
SELECT id, CASE WHEN pa AND pb AND ab THEN 'high' WHEN pa OR pb OR ab THEN 'mid' ELSE 'low' END AS grade FROM s""",
)
def job06(spark, d):
    r = reads(spark, d).withColumn("b", F.lower("gt"))
    return jobs.consensus(r, "gt", "pred", "b").select("id", "grade")


@query(
    "job10_expand_tasks",
    "SELECT o_orderkey AS doc_id, unnest(['total', 'status', 'date']) AS task, unnest([CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), o_orderstatus, strftime(o_orderdate, '%Y-%m-%d')]) AS answer FROM orders",
)
def job10(spark, d):
    f = F.col("fields")
    return reshape.expand_tasks(kie_docs(spark, d), "doc_id", {"total": F.col("total"), "status": f["status"], "date": f["date"], "none": f["missing"]})


@query(
    "job26_checkpoint_report",
    "SELECT CAST(floor(event_id / 1000) AS BIGINT) AS step, user_id < 50 AS task, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'error'), 6) AS error FROM events GROUP BY 1, 2",
)
def job26(spark, d):
    s = t(spark, d, "events").select(F.floor(F.col("event_id") / 1000).alias("step"), (F.col("user_id") < 50).alias("task"), "event_type", "value")
    return jobs.checkpoint_report(s, "step", "task", "event_type", "value", ["click", "error"]).select("step", "task", R6("click").alias("click"), R6("error").alias("error"))


@query(
    "job24_unseen_pool",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT source, doc_id FROM r WHERE r = 1 ORDER BY n_chars, doc_id LIMIT 15",
)
def job24(spark, d):
    return jobs.unseen_pool(t(spark, d, "documents"), t(spark, d, "labels").select("doc_id"), "doc_id", "source", ["n_chars", "doc_id"], 15).select("source", "doc_id")


@query("str03_job_status", "SELECT user_id, arg_max(event_type, ts) AS status, max(ts) AS at, count(*) FILTER (event_type = 'failed') AS failures FROM events GROUP BY 1")
def str03(spark, d):
    from docq.streaming.stream import job_status

    return job_status(t(spark, d, "events"), "user_id", "event_type", "ts")
