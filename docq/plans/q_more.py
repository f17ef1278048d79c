"""Further queries: prompts, checks of sums, table tokens, and composite jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docq.functions import metric, prompts, text
from docq.operators import agg, joins, reshape, rules, sampling, setops, tables
from docq.plans import jobs
from docq.plans.catalog import BOXES, LINES, READS, SCORES, boxes, html_tables, kie_docs, lines, preds, query, reads, responses, scores, t
from docq.plans.q_data import _CER

R6 = lambda c: F.round(c, 6)


@query("prj04_as_bbox", f"WITH {BOXES} SELECT doc, idx - 1 AS pos, x1, y1, x2, y2 FROM boxes")
def prj04(spark, d):
    pages, _ = reshape.pages(responses(spark, d), "doc", "body")
    b = reshape.blocks(pages, "doc")
    return b.select("doc", "pos", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


@query(
    "prj07_flatten_sections",
    "SELECT o_orderkey AS doc, 'order.priority=' || o_orderpriority || ',order.total=' || CAST(round(o_totalprice * 100) AS BIGINT) || ',order.total__num=' || CAST(round(o_totalprice * 100) AS BIGINT) AS fields FROM orders",
)
def prj07(spark, d):
    m = F.create_map(F.lit("priority"), F.concat("o_orderpriority", F.lit("")), F.lit("total"), F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"))
    out = reshape.flatten_sections(t(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), m.alias("m")), "doc", {"m": "order"})
    return out.select("doc", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("fields"))


@query(
    "prj12_taxonomy",
    "WITH m AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n FROM conversations GROUP BY 1) SELECT 'chat#' || substr(sha1('chat|' || conv_id || '|dialog'), 1, 8) AS id, CAST(conv_id AS VARCHAR) AS doc_id, 'other' AS domain, n AS num_turns FROM m",
)
def prj12(spark, d):
    m = reshape.messages(t(spark, d, "conversations"), "conv_id")
    rows = m.select(F.lit("p1").alias("package"), F.col("conv_id").cast("string").alias("doc_id"), F.lit("dialog").alias("task"), "messages", F.create_map(F.lit("a"), F.lit("b")).alias("extra"))
    packages = spark.createDataFrame([("p1", "chat", "other")], "package string, dataset_name string, domain string")
    return reshape.to_v2(rows, packages, "2").select("id", "doc_id", "domain", F.col("num_turns").cast("bigint").alias("num_turns"))


@query("prj13_replace_page", "SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'reviewed' ELSE md5(text) END AS h FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def prj13(spark, d):
    responses_ = t(spark, d, "documents").select("doc_id", F.col("text").alias("markdown"))
    reviewed = t(spark, d, "labels").where("quality = 0").select("doc_id", F.lit("reviewed").alias("markdown"))
    out = reshape.replace_page(responses_, reviewed, "doc_id")
    return out.select("doc_id", F.when(F.col("markdown") == "reviewed", F.col("markdown")).otherwise(F.md5("markdown")).alias("h"))


@query(
    "prj19_grid_from_tokens",
    f"""WITH {LINES} SELECT l_orderkey AS doc, CAST(idx - 1 AS INT) AS "row", 0 AS col, CAST(l_partkey AS VARCHAR) AS text, idx = 1 AS is_head, true AS origin FROM lines
UNION ALL SELECT l_orderkey, CAST(idx - 1 AS INT), 1, l_returnflag || '<', idx = 1, true FROM lines UNION ALL SELECT l_orderkey, CAST(idx - 1 AS INT), 2, '', idx = 1, false FROM lines""",
)
def prj19(spark, d):
    row = F.array(*[F.lit(x) for x in ("<tr>", "<td>", "</td>", "<td", ' colspan="2"', ">", "</td>", "</tr>")])
    row = F.when(F.col("idx") == 1, F.concat(F.array(F.lit("<thead>")), row, F.array(F.lit("</thead>")))).otherwise(row)
    pair = F.array(F.col("l_partkey").cast("string"), F.concat("l_returnflag", F.lit("<")))
    g = lines(spark, d).groupBy(F.col("l_orderkey").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("idx", row.alias("s"), pair.alias("c")))).alias("a"))
    return tables.grid_from_tokens(g.select("doc", F.flatten("a.s").alias("structure"), F.flatten("a.c").alias("cells")), "doc", "structure", "cells")


@query("agg09_item_hits", f"WITH {READS} SELECT tier, count(*) AS n, count(*) FILTER (contains(pred, split_part(gt, ' ', 1))) AS name_hits, count(*) FILTER (contains(pred, split_part(gt, ' ', 3))) AS price_hits FROM reads GROUP BY 1")
def agg09(spark, d):
    part, r = F.split("gt", " "), reads(spark, d)
    return agg.item_hits(r.select("id", "tier", part[0].alias("name"), part[2].alias("price")), r.select("id", F.col("pred").alias("text")), "id", ["tier"])


@query(
    "agg16_size_profile",
    """WITH r AS (SELECT p_size, p_name, row_number() OVER (ORDER BY md5('0|' || p_partkey), p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT count(*) AS n, min(p_size) AS w_min, list_sort(list(p_size))[count(*) // 2 + 1] AS w_med, max(p_size) AS w_max, min(length(p_name)) AS h_min, CAST(list_sort(list(length(p_name)))[count(*) // 2 + 1] AS INT) AS h_med, max(length(p_name)) AS h_max,
 round(list_sort(list(p_size * length(p_name) / 1000000.0))[count(*) // 2 + 1], 2) AS mp_med FROM r WHERE i % greatest(1, n // 50) = 0""",
)
def agg16(spark, d):
    return agg.size_profile(t(spark, d, "part").withColumn("high", F.length("p_name")), "p_partkey", "p_size", "high", 50)


@query(
    "agg24_causes",
    "WITH k AS (SELECT l_orderkey, avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS g, avg(l_discount * 10) AS tb, count(*) AS n, count(*) FILTER (l_quantity > 2) AS p FROM lineitem GROUP BY 1) SELECT CASE WHEN n <> p THEN 'row_count' WHEN round(tb - g, 6) > 0.15 THEN 'general_fields' WHEN round(g - tb, 6) > 0.15 THEN 'table_fields' ELSE 'overall' END AS cause, count(*) AS n FROM k WHERE g < 0.7 GROUP BY 1",
)
def agg24(spark, d):
    k = t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.avg((F.col("l_linestatus") == "F").cast("double")).alias("g"), F.avg(F.col("l_discount") * 10).alias("tb"), F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 2).alias("p")
    )
    diff = R6(F.col("tb") - F.col("g"))
    cause = rules.root_cause(F.lit(False), F.lit(1000), F.lit(False), F.col("n"), F.col("p"), F.lit(0.0), diff)
    return jobs.low_accuracy(k, cause, "g")


@query("agg35_long_error", f"WITH {SCORES} SELECT count(*) FILTER (value / 100 >= 0.9) AS scope, count(*) FILTER (value / 100 < 0.9) AS defect FROM scores WHERE cer > 1")
def agg35(spark, d):
    return agg.long_error_scope(scores(spark, d).withColumn("coverage", F.col("value") / 100), "cer", "coverage")


@query("agg37_crosscount", f"WITH {BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc, idx) AS r FROM boxes WHERE x2 - x1 >= 100 AND y2 - y1 >= 12) SELECT label, mark, count(*) AS n FROM r WHERE r <= 40 GROUP BY 1, 2")
def agg37(spark, d):
    kept = sampling.limit_per(boxes(spark, d).where("x2 - x1 >= 100 and y2 - y1 >= 12"), "label", 40, ["doc", "idx"])
    return kept.groupBy("label", "mark").agg(F.count("*").alias("n"))


@query(
    "sca08_targets",
    f"WITH {BOXES} SELECT doc, md5(string_agg(CASE label WHEN 'A' THEN '## ' ELSE '' END || 'part ' || l_suppkey, chr(10) || chr(10) ORDER BY CASE WHEN mark = 'F' THEN idx * 2 ELSE idx END, idx)) AS h FROM boxes WHERE label <> 'R' GROUP BY 1",
)
def sca08(spark, d):
    pages, _ = reshape.pages(responses(spark, d), "doc", "body")
    return reshape.build_markdown(reshape.blocks(pages, "doc"), "doc", ("table",), (), ("doc_title",)).select("doc", F.md5("markdown").alias("h"))


@query("sca10_hangul_ratio", r"SELECT doc_id, round(CASE WHEN len(regexp_extract_all(text, '\p{L}')) = 0 THEN 0 ELSE len(regexp_extract_all(text, '[가-힣]')) / len(regexp_extract_all(text, '\p{L}')) END, 6) AS ratio FROM documents")
def sca10(spark, d):
    return t(spark, d, "documents").select("doc_id", R6(text.hangul_ratio(F.col("text"))).alias("ratio"))


@query("sca15_avg_score", "SELECT event_id, round(CASE WHEN event_type = 'click' THEN (greatest(0, 1 - value / 50) + value / 100) / 2 ELSE greatest(0, 1 - value / 50) END, 6) AS score FROM events")
def sca15(spark, d):
    teds = F.when(F.col("event_type") == "click", F.col("value") / 100)
    return t(spark, d, "events").select("event_id", R6(metric.avg_score(F.col("value") / 50, teds)).alias("score"))


@query("sca21_crop_audit", "SELECT saved_as, count(*) AS n FROM (SELECT CASE WHEN abs(p_size - p_retailprice / 60) <= 1 AND abs(p_size - 20) <= 1 THEN 'scaled' WHEN abs(p_size - 20) <= 1 AND abs(p_size - 20.5) <= 1 THEN 'raw' ELSE 'neither' END AS saved_as FROM part) GROUP BY 1")
def sca21(spark, d):
    p = t(spark, d, "part").selectExpr("CAST(p_size AS DOUBLE) AS w", "CAST(p_size AS DOUBLE) AS h", "p_retailprice / 60 AS sw", "20D AS sh", "20D AS rw", "20.5D AS rh")
    return rules.crop_audit(p, "w", "h", ("sw", "sh"), ("rw", "rh")).groupBy("saved_as").agg(F.count("*").alias("n"))


@query(
    "sca23_doc_type",
    "WITH s AS (SELECT doc_id, CAST(contains(text, ' the ') AS INT) + CAST(contains(text, ' of ') AS INT) + CAST(contains(text, ' and ') AS INT) AS a, CAST(contains(text, ' der ') AS INT) + CAST(contains(text, ' die ') AS INT) AS b, CAST(contains(text, ' la ') AS INT) + CAST(contains(text, ' de ') AS INT) + CAST(contains(text, ' que ') AS INT) AS c FROM documents) SELECT doc_id, CASE WHEN greatest(a, b, c) < 2 THEN 'unknown' WHEN a = greatest(a, b, c) THEN 'english' WHEN b = greatest(a, b, c) THEN 'german' ELSE 'romance' END AS type FROM s",
)
def sca23(spark, d):
    hints = {"english": (" the ", " of ", " and "), "german": (" der ", " die "), "romance": (" la ", " de ", " que ")}
    return t(spark, d, "documents").select("doc_id", rules.doc_type(F.col("text"), hints).alias("type"))


@query(
    "sca25_receipt_sums",
    """WITH s AS (SELECT o_orderkey AS doc, CAST(round(o_totalprice) AS BIGINT) AS total, CAST(round(o_totalprice / 1.1) AS BIGINT) AS sub, CAST(round(o_totalprice) AS BIGINT) - CAST(round(o_totalprice / 1.1) AS BIGINT) + CASE WHEN o_orderstatus = 'P' THEN 7 ELSE 0 END AS tax FROM orders)
SELECT doc, sub AS subtotal, tax, total, sub + tax = total AS sum_ok, abs(round(sub * 0.1) - tax) <= 1 AS tenth_ok FROM s""",
)
def sca25(spark, d):
    o = t(spark, d, "orders")
    total, sub = F.round("o_totalprice").cast("bigint"), F.round(F.col("o_totalprice") / 1.1).cast("bigint")
    tax = total - sub + F.when(F.col("o_orderstatus") == "P", 7).otherwise(0)
    cell = lambda k, v: F.concat(F.lit(f"<tr><td>{k}</td><td>x</td><td>"), F.format_string("%,d", v), F.lit("</td></tr>"))
    # Of some orders the total stands in a line below the table, of some the tax beside no number in it.
    below = F.col("o_orderstatus") == "F"
    vat = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<tr><td>vat</td></tr><tr><td>"), F.format_string("%,d", tax), F.lit("</td></tr>"))).otherwise(cell("vat", tax))
    html = F.concat(F.lit("<table>"), cell("sub total", sub), vat, F.when(below, "").otherwise(cell("grand sum", total)), F.lit("</table>"))
    text_ = F.concat_ws("\n", F.lit("receipt 17"), F.when(below, F.format_string("Grand sum 10: see grand sum %,d won", total)), F.when(F.col("o_orderkey") % 3 == 0, F.format_string("vat 10 %% %,d", tax)))
    page = o.select(F.col("o_orderkey").alias("doc"), html.alias("html"), text_.alias("text"))
    cells, texts = tables.plain_cells(page, "doc", "html"), page.select("doc", "text")
    out = tables.find_labeled(cells, "doc", ("subtotal",), "subtotal", texts)
    for name, keys in (("tax", ("vat", "tax")), ("total", ("grandsum",))):
        out = out.join(tables.find_labeled(cells, "doc", keys, name, texts), "doc", "left")
    return rules.tenth(rules.sums_up(out, ("subtotal", "tax"), "total", "sum_ok"), "subtotal", "tax", "tenth_ok")


@query("sca27_particles", "SELECT p_partkey, w || CASE WHEN (p_partkey * 37) % 11172 % 28 <> 0 THEN '은' ELSE '는' END || chr(10) || p_type AS prompt FROM (SELECT *, p_name || chr(CAST(44032 + (p_partkey * 37) % 11172 AS INT)) AS w FROM part)")
def sca27(spark, d):
    w = F.concat("p_name", F.decode(F.encode(F.expr("decode(unhex(lpad(hex(44032 + (p_partkey * 37) % 11172), 4, '0')), 'UTF-16BE')"), "UTF-8"), "UTF-8"))
    p = t(spark, d, "part").select("p_partkey", "p_type", w.alias("w"))
    return p.select("p_partkey", prompts.build(F.lit("{field}"), prompts.particle(F.col("w"), "은", "는"), F.lit(" "), F.col("p_type")).alias("prompt"))


@query(
    "sca28_judge",
    r"""WITH a AS (SELECT p_partkey, p_size, '| ' || p_name || ' | ' || p_size || ' |' || chr(10) || p_brand AS x FROM part), n AS (SELECT *, regexp_extract_all(x, '[0-9][0-9,]*') AS n FROM a)
SELECT p_partkey, coalesce(n[1] = CAST(p_size AS VARCHAR), false) AS first_ok, len(n) = 1 AS only_one, 1 AS table_lines, 1 AS other_lines FROM n""",
)
def sca28(spark, d):
    a = F.concat(F.lit("| "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\n"), "p_brand")
    return t(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in prompts.judge(a, F.col("p_size")).items()])


@query(
    "sca29_answers",
    f"""WITH {LINES}, i AS (SELECT l_orderkey, string_agg(l_partkey || ' ' || CAST(l_quantity AS BIGINT) || ' ' || CAST(round(l_extendedprice * 100) AS BIGINT), chr(10) ORDER BY idx) AS x FROM lines GROUP BY 1)
SELECT o_orderkey AS doc_id, x AS items, '{{"status":"' || o_orderstatus || '","date":"' || strftime(o_orderdate, '%Y-%m-%d') || '","phone":null}}' AS kie FROM orders LEFT JOIN i ON l_orderkey = o_orderkey""",
)
def sca29(spark, d):
    k = kie_docs(spark, d)
    return k.select("doc_id", prompts.items_only(F.col("items")).alias("items"), prompts.json_fields(F.col("fields"), ("status", "date", "phone")).alias("kie"))


@query("sca32_defects", f"WITH {LINES} SELECT l_orderkey AS doc, CASE WHEN max(l_linenumber) > 6 THEN 'cut_table' WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'missing_rows' END AS defect FROM lines GROUP BY 1")
def sca32(spark, d):
    cut = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg((F.max("l_linenumber") > 6).alias("cut"))
    h = html_tables(spark, d).join(cut, "doc")
    fewer = F.regexp_replace("html", r'<tr class="r">(?:(?!</tr>)[\s\S])*<TD>R</td></tr>', "")
    pred = F.when(F.col("cut"), F.replace("html", F.lit("</table>"), F.lit(""))).otherwise(fewer)
    return h.select("doc", rules.defect_type(F.col("html"), pred).alias("defect"))


@query("sca37_reason_norm", "SELECT CASE WHEN starts_with(r, 'len') THEN 'len' ELSE r END AS reason, count(*) AS n FROM (SELECT CASE WHEN length(text) > 2000 THEN 'len ' || length(text) ELSE lang END AS r FROM documents) GROUP BY 1")
def sca37(spark, d):
    r = F.when(F.length("text") > 2000, F.concat(F.lit("len "), F.length("text").cast("string"))).otherwise(F.col("lang"))
    return t(spark, d, "documents").select(text.reason_key(r, ("len",)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("sca38_signed_gain", f"WITH {SCORES} SELECT event_id, CASE WHEN task = 'table' THEN round(cer - 0.5, 6) ELSE round(0.5 - cer, 6) END AS gain FROM scores")
def sca38(spark, d):
    return scores(spark, d).select("event_id", R6(metric.signed_gain(F.col("task"), F.lit(0.5), F.col("cer"))).alias("gain"))


@query("set02_merge_eval", "SELECT doc_id FROM labels WHERE quality = 0 UNION ALL SELECT doc_id FROM labels WHERE toxic = 1")
def set02(spark, d):
    x = t(spark, d, "labels")
    return setops.merge_eval(x.where("quality = 0").select("doc_id"), x.where("toxic = 1").select("doc_id"))


@query("set06_drop_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def set06(spark, d):
    return setops.drop_ids(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id")


@query(
    "job01_taxonomy",
    f"""WITH {BOXES}, p AS (SELECT doc, string_agg(CASE label WHEN 'A' THEN '# ' ELSE '' END || 'part ' || l_suppkey, chr(10) || chr(10) ORDER BY CASE WHEN mark = 'F' THEN idx * 2 ELSE idx END, idx) AS md FROM boxes GROUP BY 1)
SELECT o_orderkey AS doc, md5(md) AS h, length(md) AS n FROM p JOIN orders ON o_orderkey = doc WHERE o_orderstatus = 'F'""",
)
def job01(spark, d):
    allow = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc"))
    pages, _ = reshape.pages(joins.restrict(responses(spark, d), allow, "doc"), "doc", "body")
    md = reshape.build_markdown(reshape.blocks(pages, "doc"), "doc", ("image",), ("doc_title",), ())
    return md.select("doc", F.md5("markdown").alias("h"), F.length("markdown").alias("n"))


@query(
    "job07_review_queue",
    rf"""WITH {READS}, k AS (SELECT id, regexp_replace(regexp_replace(gt, '\s+', '', 'g'), '^[oO0*\-\s]+', '') AS p, regexp_replace(regexp_replace(pred, '\s+', '', 'g'), '^[oO0*\-\s]+', '') AS a, regexp_replace(regexp_replace(gt || model, '\s+', '', 'g'), '^[oO0*\-\s]+', '') AS b FROM reads)
SELECT id, 'low' AS grade FROM k WHERE levenshtein(p, a) / greatest(length(p), length(a), 1) > 0.02 AND levenshtein(p, b) / greatest(length(p), length(b), 1) > 0.02 AND levenshtein(a, b) / greatest(length(a), length(b), 1) > 0.02""",
)
def job07(spark, d):
    c = jobs.consensus(reads(spark, d).withColumn("b", F.concat("gt", "model")), "gt", "pred", "b")
    return jobs.review_queue(c, "id").select("id", "grade")


@query(
    "job09_trainset",
    """WITH g AS (SELECT p_partkey AS id, p_type = 'PROMO' AS hard FROM part WHERE p_type IN ('ECONOMY', 'PROMO')), h AS (SELECT id FROM g WHERE hard), c AS (SELECT id, row_number() OVER (ORDER BY md5('0|' || id), id) - 1 AS r, count(*) OVER () AS n FROM g WHERE NOT hard),
b AS (SELECT id FROM h UNION ALL SELECT id FROM c WHERE r < least(n, greatest(n // 2, floor(round((SELECT count(*) FROM h) * 0.65 / 0.35, 9))))), s AS (SELECT id, row_number() OVER (ORDER BY md5('0|' || id), id) - 1 AS r, count(*) OVER () AS n FROM b)
SELECT id, CASE WHEN r < greatest(10, floor(round(n * 0.05, 9))) THEN 'val' ELSE 'train' END AS split FROM s""",
)
def job09(spark, d):
    grade = F.when(F.col("p_type") == "ECONOMY", "high").when(F.col("p_type") == "PROMO", "mid").otherwise("low")
    return jobs.trainset_consensus(t(spark, d, "part").select(F.col("p_partkey").alias("id"), grade.alias("grade")), "id").select("id", "split")


@query(
    "job13_mix_oversample",
    f"""WITH s AS (SELECT doc_id FROM labels WHERE quality = 0), l AS (SELECT doc_id FROM labels WHERE quality = 1 ORDER BY md5('0|' || doc_id), doc_id LIMIT 200),
u AS (SELECT 'small' AS source, doc_id FROM s UNION ALL SELECT 'large', doc_id FROM l), x AS (SELECT *, CAST(('0x' || substr(md5('0|' || doc_id), 1, 8)) AS BIGINT) / 4294967295 < 0.95 AS train FROM u)
SELECT source, doc_id, train, unnest(CASE WHEN train AND source = 'small' THEN [1, 2, 3] ELSE [1] END) AS copy FROM x""",
)
def job13(spark, d):
    x = t(spark, d, "labels")
    out = jobs.mix_oversample(x.where("quality = 0").select("doc_id"), x.where("quality = 1").select("doc_id"), "doc_id", 3, 200)
    return out.select("source", "doc_id", (F.col("split") == "train").alias("train"), "copy")


@query("job22_diff_runs", f"WITH {BOXES} SELECT change, count(*) AS n FROM (SELECT CASE WHEN p.doc IS NULL THEN 'only_a' WHEN b.x1 <> p.x1 THEN 'changed' END AS change FROM boxes b LEFT JOIN preds p ON p.doc = b.doc AND p.idx = b.idx) WHERE change IS NOT NULL GROUP BY 1")
def job22(spark, d):
    return joins.run_diff(boxes(spark, d), preds(spark, d), ["doc", "idx"], "x1").groupBy("change").agg(F.count("*").alias("n"))


@query("job22_diff_blocks")
def job22_blocks(spark, d):
    return jobs.diff_runs(*two_runs(spark, d), "doc", "idx", docs=tuple(r.select("doc") for r in two_reads(spark, d)))[1]


def two_runs(spark, d):
    """two_reads with the scores of their blocks."""
    cols = ["doc", "idx", "x1", "y1", "x2", "y2"]
    return tuple(jobs.block_scores(r.drop("score", "mark", "l_suppkey"), r.select(*cols, "score"), "doc", "idx") for r in two_reads(spark, d))


def two_reads(spark, d):
    """The blocks of pages in two runs: in the second moved a little, numbered anew
    (some are gone, some new), and with other texts, orders and scores."""
    cols = ["doc", "idx", "x1", "y1", "x2", "y2", "label"]
    a = boxes(spark, d).select(*cols, "mark", "l_suppkey", F.concat(F.lit("part "), F.col("l_suppkey").cast("string")).alias("content"), F.when(F.col("mark") == "F", F.col("idx") * 2).alias("order"), (F.col("l_discount") * 10).alias("score"))
    a = a.withColumn("content", F.when(F.col("l_suppkey") % 6 == 0, "<td> </td>").otherwise(F.col("content")))
    seen = a.where("NOT (label = 'N' AND mark = 'O')")
    text_ = F.when(F.col("l_suppkey") % 4 == 0, "").when(F.col("l_suppkey") % 3 == 0, F.concat("content", F.lit(" x"))).otherwise(F.concat(F.lit("<b>"), "content", F.lit("</b>")))
    # One pass gives the rows that are moved and those that are new.
    b = seen.select("*", F.explode(F.when(F.col("idx") % 3 == 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("new"))
    new = lambda n, moved: F.when(F.col("new"), n).otherwise(moved)
    b = b.withColumns({
        "x1": new(F.col("x1") + 3000, F.col("x1") + F.col("l_suppkey") % 23 - 5), "x2": new(F.col("x2") + 3000, F.col("x2")), "y2": new(F.col("y2"), F.col("y2") + F.col("l_suppkey") % 3),
        "idx": new(F.col("idx") - 0.5, F.col("idx")), "content": new(F.col("content"), text_), "score": new(F.col("score"), F.col("score") + (F.col("l_suppkey") % 5 - 2) / 50),
    }).drop("new")
    b = b.withColumn("idx", F.row_number().over(Window.partitionBy("doc").orderBy("idx")))
    b = b.withColumn("order", F.when(F.col("order").isNotNull(), F.col("idx") * 2))
    return a, b


@query("job23_table_compare")
def job23(spark, d):
    gt, html = compared_tables(spark, d)
    return jobs.table_compare(gt, tables.cells(html, "doc", "html", repeat=True), "doc")[1]


def compared_tables(spark, d):
    """Line items as rows of a table, and the table as a parser might give it: rows
    missing, misread, spurious or with wrong numbers."""
    n = lines(spark, d).select(F.col("l_orderkey").alias("doc"), F.col("idx").alias("row"), "l_suppkey", "l_returnflag", "l_linestatus",
                               F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"), F.array(F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")).alias("numbers"))
    name = F.when(F.col("l_suppkey") % 5 == 0, F.replace("name", F.lit("part"), F.lit("pant"))).otherwise(F.col("name"))
    second = F.when(F.col("l_suppkey") % 7 == 0, "").otherwise(F.col("numbers")[1])
    row = F.concat(F.lit("<tr><td>"), name, F.lit("</td><td>"), F.col("numbers")[0], F.lit("</td><td>"), second, F.lit("</td></tr>"))
    extra = F.when(F.col("l_returnflag") == "A", "<tr><td>carried over</td><td>1</td><td>1</td></tr>").otherwise("")
    seen = n.where("NOT (l_returnflag = 'N' AND l_linestatus = 'O')")
    html = seen.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("row", F.concat(row, extra).alias("r")))).alias("a"))
    html = html.select("doc", F.concat(F.lit('<table><tr><td></td><td colspan="2">figures</td></tr>'), F.array_join("a.r", ""), F.lit("</table>")).alias("html"))
    return n.select("doc", "row", "name", "numbers"), html


@query(
    "job25_panel_index",
    f"""WITH {READS}, x AS (SELECT id, gt, CASE WHEN id % 11 <> 0 THEN upper(gt) END AS a, pred AS b FROM reads),
c AS (SELECT *, {_CER.replace('pred', 'a')} AS ca, {_CER.replace('pred', 'b')} AS cb FROM x)
SELECT id, length(gt) AS gt_chars, length(a) AS as_is_chars, round(ca, 6) AS as_is_cer, gt = a AS as_is_exact, length(b) AS to_be_chars, round(cb, 6) AS to_be_cer, gt = b AS to_be_exact, round(ca - cb, 6) AS gain,
  CASE WHEN ca IS NULL THEN 'missing' WHEN ca > cb THEN 'better' WHEN ca < cb THEN 'worse' ELSE 'same' END AS verdict FROM c""",
)
def job25(spark, d):
    r = reads(spark, d)
    arms = r.where("id % 11 <> 0").select("id", "gt", F.upper("gt").alias("pred"), F.lit("before").alias("arm")).unionByName(r.select("id", "gt", "pred", F.lit("after").alias("arm")))
    out = jobs.panel_index(arms, "id", "arm", "before", "after")
    return out.withColumns({c: F.round(c, 6) for c in ("as_is_cer", "to_be_cer", "gain")})


@query(
    "sca34_root_cause",
    """WITH k AS (SELECT l_orderkey AS doc, avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS g, avg(l_discount * 10) AS tb, count(*) AS gn, count(*) FILTER (l_quantity > 2) AS pn, sum(l_quantity) AS chars, bool_and(l_returnflag = 'R') AS lost FROM lineitem GROUP BY 1)
SELECT doc, CASE WHEN pn = 0 THEN 'missing_prediction' WHEN chars <= 120 THEN 'empty_parse' WHEN lost THEN 'table_lost' WHEN gn <> pn THEN 'row_count' WHEN round(tb - g, 6) > 0.15 THEN 'general_fields' WHEN round(g - tb, 6) > 0.15 THEN 'table_fields' ELSE 'overall' END AS cause FROM k""",
)
def sca34(spark, d):
    k = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(
        F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)).alias("g"), F.avg(F.col("l_discount") * 10).alias("tb"), F.count("*").alias("gn"), F.count_if(F.col("l_quantity") > 2).alias("pn"),
        F.sum("l_quantity").alias("chars"), F.bool_and(F.col("l_returnflag") == "R").alias("lost"),
    )
    diff = F.round(F.col("tb") - F.col("g"), 6)
    return k.select("doc", rules.root_cause(F.col("pn") == 0, F.col("chars"), F.col("lost"), F.col("gn"), F.col("pn"), F.lit(0.0), diff).alias("cause"))


@query(
    "job17_score_predictions",
    f"""WITH {READS}, m AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'table' ELSE 'text' END AS task FROM reads WHERE id % 7 <> 0), s AS (SELECT model, task, {_CER} AS cer, gt = pred AS ok FROM m),
tk AS (SELECT model, task, count(*) AS n, sum(cer) AS s, avg(cer) AS m, count(*) FILTER (ok) AS e FROM s GROUP BY 1, 2)
SELECT model, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS micro, round(avg(m), 6) AS macro, CAST(sum(e) AS BIGINT) AS exact FROM tk GROUP BY 1""",
)
def job17(spark, d):
    # The predictions' own idea of the truth is not read; crops that were dropped are not scored.
    r = reads(spark, d)
    manifest = r.where("id % 7 <> 0").select("id", "gt", F.when(F.col("id") % 3 == 0, "table").otherwise("text").alias("task"))
    out = jobs.score_predictions(manifest, r.select("id", "model", "pred"), "id")
    return out.select("model", "n", R6("micro").alias("micro"), R6("macro").alias("macro"), "exact")


@query(
    "win_tumbling_events",
    "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def tumbling(spark, d):
    from docq.streaming.stream import windowed_counts

    return windowed_counts(t(spark, d, "events"), "ts", "event_type", "1 hour")
