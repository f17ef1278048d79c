"""Queries of composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docq.functions import metric
from docq.operators import reshape, rules
from docq.plans import jobs
from docq.plans.catalog import BOXES, LINES, READS, boxes, html_tables, kie_docs, lines, query, reads, t
from docq.plans.q_data import _GROUPED
from docq.plans.q_text import _FIELDS


def customer_fields(spark, d):
    pair = lambda k, v: F.struct(F.lit(k).alias("field"), v.cast("string").alias("value"))
    rows = F.array(pair("merchant_name", F.col("c_name")), pair("total", F.col("c_acctbal")), pair("transaction_date", F.col("c_mktsegment")), pair("merchant_phone", F.col("c_mktsegment")))
    return t(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.inline(rows))


@query("prj11_taxonomy_v0", "SELECT CAST(doc_id AS VARCHAR) AS source_file, md5(text) AS h, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'eng' ELSE 'other' END AS language FROM documents")
def prj11(spark, d):
    v = reshape.to_v0(t(spark, d, "documents"), "docs", "What does it say?", "doc_id", "text")
    return v.select("metadata.source_file", F.md5("completion.chosen").alias("h"), "language")


@query(
    "sca25_balance_sheet",
    "SELECT l_orderkey AS doc, bool_and(CAST(l_quantity AS BIGINT) = CAST(l_quantity AS BIGINT) + CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS balanced FROM lineitem GROUP BY 1",
)
def sca25(spark, d):
    q = F.col("l_quantity").cast("bigint")
    s = t(spark, d, "lineitem").withColumns({"a": q, "c": q + F.when(F.col("l_tax") > 0.07, 1).otherwise(0)})
    g = s.groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(F.struct("a", "c")).alias("p"))
    return g.select("doc", rules.balance_sheet(F.col("p.a"), F.col("p.c")).alias("balanced"))


@query("sca36_diff_marks")
def sca36(spark, d):
    r = reads(spark, d)
    return r.select("id", F.to_json(metric.diff_marks("gt", "pred")).alias("marks"))


@query(
    "job03_clean_docs",
    f"""WITH {LINES}, i AS (SELECT l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q FROM lines), s AS (SELECT l_orderkey, CAST(sum(c) AS BIGINT) AS total, bool_or((c // q) * q <> c) AS bad, count(*) AS n FROM i GROUP BY 1)
SELECT o_orderkey AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_items, coalesce(s.total, 0) = CAST(round(o_totalprice * 100) AS BIGINT) AND NOT coalesce(bad, false) AS passed FROM orders LEFT JOIN s ON s.l_orderkey = o_orderkey""",
)
def job03(spark, d):
    docs = kie_docs(spark, d).withColumn("tax", F.lit(0).cast("bigint"))
    docs = docs.withColumn("fields", F.map_filter("fields", lambda k, _: k.isin("priority", "date")))
    return jobs.clean_docs(docs, "item_total", "tax", "total").select("doc_id", F.size("items").cast("bigint").alias("n_items"), "passed")


@query(
    "job04_field_vqa",
    f"WITH {_FIELDS} SELECT doc, field, 'what is the ' || replace(field, '_', ' ') || '?' AS question, value AS answer FROM f WHERE field IN ('merchant_name', 'total')",
)
def job04(spark, d):
    questions = spark.createDataFrame([(f, f"what is the {f.replace('_', ' ')}?") for f in ("merchant_name", "total", "merchant_phone")], "field string, question string")
    return jobs.field_vqa(customer_fields(spark, d), questions, "doc")


@query(
    "job05_page_ocr",
    f"""WITH RECURSIVE {BOXES}, {_GROUPED}, bins AS (SELECT doc, floor(x1 / 15) AS bin, count(*) AS n FROM boxes GROUP BY 1, 2),
tl AS (SELECT doc, sum(n) >= 20 AND count(*) FILTER (n >= 5) >= 2 AS tl FROM bins GROUP BY 1),
f AS (SELECT doc, count(*) AS n, avg(CASE WHEN label = 'R' THEN 1.0 ELSE 0.0 END) AS h, count(*) FILTER (trim(mark) <> '') AS texts FROM boxes GROUP BY 1),
l AS (SELECT doc, line, string_agg(label || idx, ' ' ORDER BY x1, idx) AS t FROM boxes JOIN grouped USING (doc, idx) GROUP BY 1, 2)
SELECT doc, string_agg(t, chr(10) ORDER BY line) AS text FROM l JOIN f USING (doc) JOIN tl USING (doc) WHERE n >= 2 AND h <= 0.5 AND NOT tl AND texts > 0 GROUP BY doc""",
)
def job05(spark, d):
    b = boxes(spark, d).withColumn("word", F.concat("label", F.col("idx").cast("string")))
    drops = rules.page_drop_reason(b.withColumn("hand", F.col("label") == "R"), "doc", "x1", "hand", "mark", min_boxes=2, hand_max=0.5)
    return jobs.page_ocr_pack(b, "doc", "idx", drops)


@query(
    "job11_unify_receipts",
    """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('0|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels), s AS (SELECT *, floor(round(n * 0.8, 9)) AS a, floor(round(n * 0.1, 9)) AS b FROM r),
g AS (SELECT conv_id, row_number() OVER (ORDER BY md5('0|' || conv_id), conv_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)), x AS (SELECT *, greatest(1, floor(round(n * 0.1, 9))) AS a FROM g),
c AS (SELECT conv_id, conv_id * 1000 + turn AS doc_id, CASE WHEN r < a THEN 'test' WHEN r < 2 * a THEN 'val' ELSE 'train' END AS split FROM conversations JOIN x USING (conv_id)), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY md5('0|' || doc_id), doc_id) AS k FROM c)
SELECT 'layered' AS source, doc_id, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'val' ELSE 'test' END AS split FROM s UNION ALL SELECT 'grouped', doc_id, CASE WHEN split <> 'train' AND k > 3 THEN 'train' ELSE split END FROM k""",
)
def job11(spark, d):
    turns = t(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"))
    return jobs.unify_receipts(t(spark, d, "labels"), "quality", turns, "conv_id", "doc_id", 3).select("source", "doc_id", "split")


@query(
    "job12_mix_select",
    f"""WITH {LINES}, s AS (SELECT page_id AS doc, CASE WHEN contains(lower(html), '<table') OR regexp_matches(html, '(?m)^\\|.*\\|') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(html, '\\$.+?\\$|\\\\\\(|\\\\begin\\{{(?:equation|align)') THEN 2 ELSE 0 END
 + CASE WHEN len(list_distinct(regexp_extract_all(html, '(?m)^(#{{1,6}})\\s', 1))) >= 2 THEN 2 WHEN len(regexp_extract_all(html, '(?m)^(#{{1,6}})\\s', 1)) > 0 THEN 1 ELSE 0 END + CASE WHEN length(html) > 800 THEN 1 ELSE 0 END AS k FROM pages),
b AS (SELECT conv_id * 1000 + turn AS doc, CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 800 THEN 'mid' ELSE 'long' END AS bucket FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('0|' || doc), doc) AS r, CASE bucket WHEN 'short' THEN 3 WHEN 'mid' THEN 28 ELSE 29 END AS q, CASE bucket WHEN 'long' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END AS turn FROM b),
n AS (SELECT l_orderkey AS doc, count(*) AS n FROM lines GROUP BY 1)
(SELECT 'structure' AS source, doc FROM s WHERE k > 0 ORDER BY k DESC, doc LIMIT 60) UNION ALL (SELECT 'length', doc FROM r ORDER BY CAST(r > q AS INT), turn, r LIMIT 60) UNION ALL (SELECT 'table', doc FROM n WHERE n * 2 >= 12 AND n >= 3 ORDER BY n DESC, doc LIMIT 60)""",
)
def job12(spark, d):
    pages = t(spark, d, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("text"))
    conv = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    return jobs.mix_select(pages, conv, html_tables(spark, d).withColumnRenamed("html", "text"), "text", "doc", 60).select("source", "doc")


@query(
    "job15_labeling_upload",
    f"WITH {BOXES} SELECT doc, idx, least(x1 * 1.5, 700) AS x1, least(x2 * 1.5, 700) AS x2, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN mark = 'F' THEN idx * 2 ELSE idx END, idx) - 1 AS \"order\", CASE WHEN least(x2 * 1.5, 700) <= least(x1 * 1.5, 700) THEN 'no_width' ELSE '' END AS errors FROM boxes",
)
def job15(spark, d):
    b = boxes(spark, d).withColumn("order_key", F.when(F.col("mark") == "F", F.col("idx") * 2).otherwise(F.col("idx"))).withColumn("pos", F.col("idx"))
    return reshape.labeling_upload(b, "doc", 1.5, 0.5, 700.0, 3000.0).select("doc", "idx", "x1", "x2", "order", F.array_join("errors", ",").alias("errors"))


@query(
    "job16_crop_manifest",
    f"""WITH {BOXES}, p AS (SELECT doc, idx, CASE label WHEN 'A' THEN 'text' WHEN 'R' THEN 'table' END AS task, CAST(trunc(greatest(0, x1 - greatest(8, (x2 - x1) * 0.05))) AS INT) AS x1, CAST(trunc(greatest(0, y1 - greatest(8, (y2 - y1) * 0.05))) AS INT) AS y1,
 CAST(trunc(least(500, x2 + greatest(8, (x2 - x1) * 0.05))) AS INT) AS x2, CAST(trunc(least(900, y2 + greatest(8, (y2 - y1) * 0.05))) AS INT) AS y2 FROM boxes)
SELECT doc, idx, task, x1, y1, x2, y2 FROM p WHERE task IS NOT NULL AND x2 - x1 >= 2 AND y2 - y1 >= 2""",
)
def job16(spark, d):
    routes = spark.createDataFrame([("A", "text"), ("R", "table")], "label string, task string")
    crops, _ = reshape.crop_manifest(boxes(spark, d), "doc", "idx", "label", routes, 500, 900, 0.05, 8)
    return crops.select("doc", "idx", "task", *[F.col(f"c{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "job20_doc_report",
    f"WITH {READS} SELECT id, 'name' AS field, gt, pred, CASE WHEN pred IS NULL THEN 'missing_prediction' ELSE 'ok' END AS status, contains(upper(gt), gt) AS in_text FROM reads",
)
def job20(spark, d):
    r = reads(spark, d).withColumn("field", F.lit("name"))
    out = jobs.doc_report(r.select("id", "field", F.col("gt").alias("value")), r.select("id", "field", F.col("pred").alias("value")), r.select("id", F.upper("gt").alias("text")), "id")
    return out.select("id", "field", "gt", "pred", "status", "in_text")


_REVIEWED = """v AS (SELECT id, model AS image, gt, pred, CASE WHEN tier = 'ECONOMY' THEN 'high' WHEN tier = 'PROMO' THEN 'mid' ELSE 'low' END AS grade, id % 7 = 0 AS changed,
  CASE WHEN tier = 'STANDARD' THEN 'parser' WHEN tier = 'SMALL' THEN 'other' WHEN tier = 'MEDIUM' AND id % 2 = 0 THEN ' Model' END AS verdict, CASE WHEN id % 3 = 0 THEN ' fixed ' END AS correct FROM reads WHERE NOT contains(model, '#2')),
 s AS (SELECT *, CASE WHEN verdict IS NULL AND (grade = 'low' OR changed) THEN 'waiting' WHEN verdict = 'other' AND correct IS NULL THEN 'no_correction' END AS reason FROM v)"""


@query(
    "job08_apply_review",
    f"""WITH {READS}, {_REVIEWED} SELECT id, CASE WHEN reason IS NULL THEN image END AS image, grade, CASE WHEN reason IS NULL THEN trim(CASE verdict WHEN 'parser' THEN gt WHEN 'other' THEN correct ELSE pred END) END AS label,
 CASE WHEN reason IS NULL THEN CASE WHEN verdict IS NULL THEN 'consensus' ELSE 'human' END END AS source, reason FROM s""",
)
def job08(spark, d):
    r = reads(spark, d)
    grade = F.when(F.col("tier") == "ECONOMY", "high").when(F.col("tier") == "PROMO", "mid").otherwise("low")
    c = r.select("id", F.col("model").alias("image"), grade.alias("grade"), (F.col("id") % 7 == 0).alias("parser_changed"), F.col("gt").alias("parser"), F.col("pred").alias("label"))
    verdict = F.when(F.col("tier") == "STANDARD", "parser").when(F.col("tier") == "SMALL", "other").when((F.col("tier") == "MEDIUM") & (F.col("id") % 2 == 0), " Model")
    gt, blocked = jobs.apply_review(c, r.select("id", verdict.alias("verdict"), F.when(F.col("id") % 3 == 0, " fixed ").alias("correct")), "id", ["#2"])
    none = F.lit(None).cast("string")
    return gt.select("id", "image", "grade", "label", "source", none.alias("reason")).unionByName(blocked.select("id", none.alias("image"), "grade", none.alias("label"), none.alias("source"), "reason"))


@query(
    "job14_taxonomy_tree",
    """SELECT o_orderpriority AS package, CASE o_orderstatus WHEN 'F' THEN 'filled' ELSE 'open' END AS dataset_name, CASE o_orderstatus WHEN 'F' THEN 'extraction' WHEN 'O' THEN 'ocr' ELSE 'vqa' END AS category, count(*) AS sample_count,
 o_orderpriority || '/' || CASE o_orderstatus WHEN 'F' THEN 'filled' ELSE 'open' END || '/' || CASE o_orderstatus WHEN 'F' THEN 'extraction' WHEN 'O' THEN 'ocr' ELSE 'vqa' END || '.json' AS path FROM orders GROUP BY 1, 2, 3, 5""",
)
def job14(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderpriority").alias("package"), F.col("o_orderstatus").alias("task"), "o_orderkey")
    name = F.when(F.col("task") == "F", "filled").otherwise("open")
    category = F.when(F.col("task") == "F", "extraction").when(F.col("task") == "O", "ocr").otherwise("vqa")
    tasks = rows.select("package", "task").distinct().withColumn("dataset_name", name).withColumn("category", category)
    return jobs.taxonomy_tree(rows, tasks, "package", "task")[1]


_FIELD_SCORES = """s AS (SELECT l_orderkey AS doc, o_orderpriority AS doc_type, CASE WHEN idx = 1 THEN 'general' ELSE 'table' END AS part, idx AS row, l_returnflag AS field,
  CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.5 END END AS score, true AS in_gt, l_linestatus = 'F' OR l_quantity > 25 AS in_pred
  FROM lines JOIN orders ON o_orderkey = l_orderkey),
 k AS (SELECT doc, doc_type, coalesce(sum(score) FILTER (part = 'general'), 0) AS gs, count(*) FILTER (part = 'general') AS gn, coalesce(sum(score) FILTER (part = 'table'), 0) AS ts, count(*) FILTER (part = 'table') AS tn,
  count(*) FILTER (part = 'table') AS gr, count(*) FILTER (part = 'table' AND in_pred) AS pr, count(score) AS predicted FROM s GROUP BY 1, 2)"""


def _field_scores(spark, d):
    j = lines(spark, d).join(t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(
        F.col("l_orderkey").alias("doc"), F.col("o_orderpriority").alias("doc_type"), F.when(F.col("idx") == 1, "general").otherwise("table").alias("part"), F.col("idx").alias("row"), F.col("l_returnflag").alias("field"),
        F.when(F.col("l_linestatus") == "F", F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.5)).alias("score"), F.lit(True).alias("in_gt"), ((F.col("l_linestatus") == "F") | (F.col("l_quantity") > 25)).alias("in_pred"),
    )


@query(
    "job18_kie_eval",
    f"""WITH {LINES}, {_FIELD_SCORES} SELECT doc_type, count(*) AS docs, round(sum(gs) / sum(gn), 6) AS general, round(sum(ts) / sum(tn), 6) AS "table", round(sum(gs + ts) / sum(gn + tn), 6) AS total, count(*) FILTER (gr <> pr) AS row_mismatch
 FROM k GROUP BY ROLLUP (doc_type)""",
)
def job18(spark, d):
    _, figures = jobs.kie_eval(_field_scores(spark, d), "doc", "doc_type")
    return figures.select("doc_type", "docs", *[F.round(c, 6).alias(c) for c in ("general", "table", "total")], "row_mismatch")


@query(
    "job19_kie_low_accuracy",
    f"""WITH {LINES}, {_FIELD_SCORES}, low AS (SELECT doc, CASE WHEN predicted = 0 THEN 'no_prediction' WHEN gr <> pr THEN 'row_mismatch' WHEN ts * gn < gs * tn THEN 'table' ELSE 'general' END AS cause
  FROM k WHERE predicted = 0 OR (gs + ts) / (gn + tn) < 0.7)
 SELECT 'cause' AS kind, cause AS name, count(*) AS n, count(*) AS docs FROM low GROUP BY 2
 UNION ALL SELECT 'field', field, count(*), count(DISTINCT doc) FROM s WHERE doc IN (SELECT doc FROM low) AND coalesce(score, 0) < 1 GROUP BY 2""",
)
def job19(spark, d):
    s = _field_scores(spark, d)
    docs, _ = jobs.kie_eval(s, "doc", "doc_type")
    _, causes, fields = jobs.kie_low_accuracy(docs, s, "doc")
    return causes.select(F.lit("cause").alias("kind"), F.col("cause").alias("name"), "n", F.col("n").alias("docs")).unionByName(fields.select(F.lit("field").alias("kind"), F.col("field").alias("name"), F.col("failures").alias("n"), "docs"))
