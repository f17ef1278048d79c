"""Queries of rules and text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docq.functions import num, text
from docq.operators import rules
from docq.plans.catalog import query, t


def sql_lines(extra: str = "") -> str:
    return f"lines AS (SELECT doc_id, trim(x) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> ''{extra})"


@query("flt01_length_bounds", "SELECT doc_id, CASE WHEN length(text) < 30 THEN 'short' WHEN length(text) > 8000 THEN 'long' END AS length_flag FROM documents")
def flt01(spark, d):
    return rules.length_flag(t(spark, d, "documents"), "text").select("doc_id", "length_flag")


@query(
    "flt02_repeated_line",
    f"WITH {sql_lines()}, m AS (SELECT doc_id, line, count(*) AS n FROM lines WHERE length(line) >= 6 GROUP BY 1, 2) SELECT doc_id, coalesce(max(n) >= 4, false) AS repeated_line FROM documents LEFT JOIN m USING (doc_id) GROUP BY 1",
)
def flt02(spark, d):
    return rules.repeated_line(t(spark, d, "documents"), "text").select("doc_id", "repeated_line")


@query(
    "flt03_bad_chars",
    r"SELECT doc_id, contains(text, chr(65533)) AS replacement_char, regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]') AS control_char FROM documents",
)
def flt03(spark, d):
    return rules.bad_chars(t(spark, d, "documents"), "text").select("doc_id", "replacement_char", "control_char")


@query("flt04_html_residue", "SELECT page_id, contains(html, '<td') OR contains(html, '<table') AS html_residue FROM pages")
def flt04(spark, d):
    return rules.html_residue(t(spark, d, "pages"), "html").select("page_id", "html_residue")


@query(
    "flt05_ragged_table",
    r"""WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
r AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS b, length(line) - length(replace(line, '|', '')) AS n FROM l WHERE regexp_matches(line, '^\|.*\|$')),
g AS (SELECT doc_id, min(n) <> max(n) AS x FROM r GROUP BY doc_id, b)
SELECT doc_id, coalesce(bool_or(x), false) AS ragged FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id""",
)
def flt05(spark, d):
    return rules.ragged_table(t(spark, d, "documents"), "doc_id", "text")


@query(
    "flt06_empty_table",
    r"""WITH c AS (SELECT doc_id, regexp_extract_all(text, '\|([^|\n]*)', 1) AS c FROM documents)
SELECT doc_id, coalesce(len(c) >= 12 AND len(list_filter(c, lambda x: regexp_matches(trim(x), '^-*$'))) / len(c) > 0.6, false) AS empty_table FROM c""",
)
def flt06(spark, d):
    return rules.empty_table(t(spark, d, "documents"), "text").select("doc_id", "empty_table")


@query("flt07_duplicate_answers", "SELECT md5(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def flt07(spark, d):
    return rules.duplicate_text(t(spark, d, "documents"), "text")


@query(
    "flt08_duplicate_refs",
    "SELECT ref, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey AS ref FROM lineitem) GROUP BY 1 HAVING count(*) > 1",
)
def flt08(spark, d):
    docs = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("refs"))
    return rules.duplicate_ref(docs, "refs")


@query("flt09_vocabulary", "SELECT event_id, event_type FROM events WHERE event_type NOT IN (SELECT event_type FROM events GROUP BY 1 HAVING avg(value) > 49)")
def flt09(spark, d):
    e = t(spark, d, "events")
    vocab = e.groupBy("event_type").agg(F.avg("value").alias("v")).where("v > 49").select("event_type")
    return rules.outside_vocab(e, vocab, ["event_type"]).select("event_id", "event_type")


@query(
    "flt10_required",
    "SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'text' END, CASE WHEN trim(coalesce(lang, '')) = '' THEN 'lang' END, CASE WHEN quality IS NULL THEN 'quality' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents LEFT JOIN labels USING (doc_id)",
)
def flt10(spark, d):
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return rules.required(docs, ["text", "lang", "quality"]).select("doc_id", F.array_join("missing", ",").alias("missing"))


def _phrases(level):
    return " OR ".join(f"contains(lower(text), '{p}')" for p in (rules.META_DOC if level == "doc" else rules.META_BLOCK))


@query("flt11_meta_phrases", f"SELECT doc_id, coalesce({_phrases('doc')}, false) AS doc_flag, coalesce({_phrases('block')}, false) AS block_flag FROM documents")
def flt11(spark, d):
    docs = rules.meta_phrases(t(spark, d, "documents"), "text").withColumnRenamed("meta_phrase", "doc_flag")
    return rules.meta_phrases(docs, "text", "block").select("doc_id", "doc_flag", F.col("meta_phrase").alias("block_flag"))


@query(
    "flt12_rising_sequence",
    r"""SELECT doc_id, len(regexp_extract_all(coalesce(regexp_extract(text, '(?:[0-9]{3,4}\s*[-–]\s*[0-9]{3,4}\s+){6,}'), ''), '[0-9]{3,4}\s*[-–]\s*[0-9]{3,4}')) AS rising FROM documents""",
)
def flt12(spark, d):
    return rules.rising_sequence(t(spark, d, "documents"), "text").select("doc_id", "rising")


@query(
    "flt13_token_shape_loop",
    r"""WITH l AS (SELECT doc_id, i, list_filter(string_split_regex(regexp_replace(ls[i], '[0-9]+', '#', 'g'), '\s+'), lambda x: x <> '') AS tk FROM (
  SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
c AS (SELECT doc_id, i, s, count(*) AS n FROM (SELECT doc_id, i, unnest(tk) AS s FROM l WHERE len(tk) >= 8) GROUP BY 1, 2, 3)
SELECT doc_id, coalesce(max(n), 0) AS shape_loop, coalesce(max(n), 0) >= 25 AS shape_flag FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id""",
)
def flt13(spark, d):
    return rules.token_shape_loop(t(spark, d, "documents"), "text").select("doc_id", "shape_loop", "shape_flag")


@query(
    "flt14_latin_intrusion",
    r"""WITH w AS (SELECT doc_id, text, len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{4,}'))) AS n FROM documents)
SELECT doc_id, length(text) > 300 AND n >= 30 AND len(regexp_extract_all(text, '[a-z]{3,}[.,;] ')) >= 5 AS latin_intrusion FROM w""",
)
def flt14(spark, d):
    return rules.latin_intrusion(t(spark, d, "documents"), "text", level="block").select("doc_id", "latin_intrusion")


@query("flt15_fence_residue", "SELECT doc_id, contains(text, '```') AS fence_residue FROM documents")
def flt15(spark, d):
    return rules.fence_residue(t(spark, d, "documents"), "text").select("doc_id", "fence_residue")


@query(
    "flt16_ngram_repeat",
    """WITH g AS (SELECT conv_id, turn, text, unnest(range(1, length(text) - 10)) AS i FROM conversations WHERE length(text) >= 36),
c AS (SELECT conv_id, turn, substring(text, i, 12) AS s, length(text) AS len, count(*) AS n FROM g GROUP BY 1, 2, 3, 4)
SELECT v.conv_id, v.turn, round(coalesce(max(n) * 12 / max(len), 0.0), 6) AS ratio FROM conversations v LEFT JOIN c ON c.conv_id = v.conv_id AND c.turn = v.turn GROUP BY 1, 2""",
)
def flt16(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.round(rules.ngram_repeat(F.col("text")), 6).alias("ratio"))


@query(
    "flt17_line_surplus",
    f"WITH {sql_lines()}, m AS (SELECT doc_id, line, count(*) AS n FROM lines GROUP BY 1, 2 HAVING count(*) >= 3) SELECT doc_id, CAST(coalesce(sum(n - 2), 0) AS BIGINT) AS surplus FROM documents LEFT JOIN m USING (doc_id) GROUP BY 1",
)
def flt17(spark, d):
    return rules.line_surplus(t(spark, d, "documents"), "doc_id", "text")


_FIELDS = """f AS (SELECT c_custkey AS doc, unnest(['merchant_name', 'total', 'transaction_date', 'merchant_phone']) AS field, unnest([c_name, CAST(c_acctbal AS VARCHAR), c_mktsegment, c_mktsegment]) AS value FROM customer)"""


@query(
    "flt18_field_flags",
    rf"""WITH {_FIELDS} SELECT doc, field, array_to_string(list_filter([CASE WHEN length(value) <= 1 THEN 'one_char' END,
  CASE WHEN regexp_matches(value, '[^\pL\pN_\s.,:()/#*&''"~+@%-]') THEN 'odd_char' END,
  CASE WHEN field = 'merchant_phone' AND NOT regexp_matches(value, '[0-9]{{2,4}}[-\s)]?\s?[0-9]{{3,4}}[-\s]?[0-9]{{4}}') THEN 'not_a_phone' END,
  CASE WHEN field = 'total' AND NOT regexp_matches(value, '[0-9]') THEN 'money_without_digit' END,
  CASE WHEN field = 'transaction_date' AND NOT regexp_matches(value, '[0-9]') THEN 'date_without_digit' END], lambda x: x IS NOT NULL), ',') AS flags FROM f""",
)
def flt18(spark, d):
    pair = lambda k, v: F.struct(F.lit(k).alias("field"), v.cast("string").alias("value"))
    rows = F.array(pair("merchant_name", F.col("c_name")), pair("total", F.col("c_acctbal")), pair("transaction_date", F.col("c_mktsegment")), pair("merchant_phone", F.col("c_mktsegment")))
    f = t(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.inline(rows))
    return f.select("doc", "field", F.array_join(rules.field_flags(F.col("field"), F.col("value")), ",").alias("flags"))


@query(
    "flt19_pii_safe",
    "SELECT doc_id FROM documents WHERE source NOT IN ('doc_title', 'header', 'footer')" + "".join(f" AND NOT regexp_matches(text, '{p}')" for p in rules.PII),
)
def flt19(spark, d):
    return rules.pii_safe(t(spark, d, "documents"), "text", "source").select("doc_id")


@query("flt20_route_labels", "SELECT task, count(*) AS n FROM (SELECT CASE p_type WHEN 'ECONOMY' THEN 'table' WHEN 'STANDARD' THEN 'text' ELSE 'unknown' END AS task FROM part) GROUP BY 1")
def flt20(spark, d):
    routes = spark.createDataFrame([("ECONOMY", "table"), ("STANDARD", "text")], "p_type string, task string")
    return rules.route_labels(t(spark, d, "part"), "p_type", routes).groupBy("task").agg(F.count("*").alias("n"))


@query("flt25_size_reason", "SELECT p_partkey, CASE WHEN least(p_size * 20, p_retailprice / 2) < 200 THEN 'small' WHEN p_size * 20 / (p_retailprice / 2) > 1.6 THEN 'wide' END AS size_reason FROM part")
def flt25(spark, d):
    p = t(spark, d, "part").selectExpr("p_partkey", "CAST(p_size * 20 AS DOUBLE) AS w", "p_retailprice / 2 AS h")
    return rules.size_reason(p, "w", "h").select("p_partkey", "size_reason")


@query(
    "flt26_license_gate",
    "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2)) AND s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING avg(s_acctbal) > 3000)",
)
def flt26(spark, d):
    s = t(spark, d, "supplier")
    status = s.groupBy("s_nationkey").agg(F.when(F.avg("s_acctbal") > 3000, "approved").otherwise("open").alias("review_status"))
    registry = status.join(t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit("L"), F.col("n_regionkey").cast("string")).alias("license")), "s_nationkey")
    return rules.license_gate(s, registry, "s_nationkey", ("L1", "L2")).select("s_suppkey")


@query(
    "flt27_script_share",
    """WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM r WHERE nth <= 4 AND length(text) >= 500 AND len(regexp_extract_all(text, '[aeiou]')) / length(text) >= 0.2) SELECT source, doc_id FROM g WHERE k = 1""",
)
def flt27(spark, d):
    return rules.script_share_page(t(spark, d, "documents"), "source", "doc_id", "text", "[aeiou]").select("source", "doc_id")


@query("flt28_crop_text", "SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'no_text' WHEN length(trim(text)) > 200 THEN 'too_long' END AS crop_reason FROM conversations")
def flt28(spark, d):
    return rules.crop_text_reason(t(spark, d, "conversations"), "text").select("conv_id", "turn", "crop_reason")


@query("sca03_norm_space", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def sca03(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.norm_space(F.col("text"))).alias("h"))


@query(
    "sca05_strip_tags",
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)</tr\s*>', chr(10), 'g'), '(?i)</t[dh]\s*>', ' ', 'g'), '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'))) AS plain,
md5(trim(regexp_replace(html, '>\s+<', '><', 'g'))) AS compact FROM pages""",
)
def sca05(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("plain"), F.md5(text.compact_html(F.col("html"))).alias("compact"))


@query(
    "sca09_language",
    r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[가-힣]')) AS k, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)
SELECT doc_id, CASE WHEN k + l = 0 THEN 'other' WHEN k / (k + l) > 0.8 THEN 'kor' WHEN k / (k + l) < 0.2 THEN 'eng' ELSE 'mix' END AS language FROM c""",
)
def sca09(spark, d):
    return t(spark, d, "documents").select("doc_id", text.detect_language(F.col("text")).alias("language"))


@query("sca11_numbers", r"SELECT c_custkey, TRY_CAST(regexp_replace(c_name, '[^0-9-]', '', 'g') AS BIGINT) AS as_int, CAST(trunc(c_acctbal) AS BIGINT) AS as_num FROM customer")
def sca11(spark, d):
    return t(spark, d, "customer").select("c_custkey", num.to_int(F.col("c_name")).alias("as_int"), num.to_num(F.col("c_acctbal")).alias("as_num"))


@query(
    "sca12_digits",
    r"""WITH n AS (SELECT doc_id, md5(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, list_transform(regexp_extract_all(text, '[0-9][0-9,]*'), lambda x: replace(x, ',', '')) AS tk FROM documents) SELECT doc_id, digits, len(tk) AS tokens, array_to_string(tk, ' ') AS listed FROM n""",
)
def sca12(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", F.md5(num.digits(c)).alias("digits"), F.size(num.tokens(c)).alias("tokens"), F.array_join(num.tokens(c), " ").alias("listed"))


@query("sca35_unprintable", r"SELECT doc_id, md5(regexp_replace(replace(text, chr(65533), ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]|\p{Cf}|\p{Co}', '', 'g')) AS h FROM documents")
def sca35(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.drop_unprintable(F.col("text"))).alias("h"))


@query(
    "sca39_safe_table",
    r"""SELECT page_id, md5(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'),
  '(?i)<(/?(?:table|thead|tbody|tr|td|th|br)\b[^<>]*)>', chr(1) || '\1' || chr(2), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(1), '<'), chr(2), '>')) AS h FROM pages""".replace("chr(2), '>'))", "chr(2), '>'))"),
)
def sca39(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(text.safe_table(F.col("html"))).alias("h"))


@query("prj16_stem", r"SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '^(.+)\.[^.]*$', '\1') AS stem FROM pages")
def prj16(spark, d):
    return t(spark, d, "pages").select("page_id", text.stem(F.col("url")).alias("stem"))


@query(
    "job02_validate",
    f"""WITH {sql_lines()}, m AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE length(line) >= 6 GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT unnest(list_filter([CASE WHEN length(text) < 30 THEN 'short' WHEN length(text) > 8000 THEN 'long' END, CASE WHEN n >= 4 THEN 'repeated_line' END, CASE WHEN contains(text, chr(65533)) THEN 'replacement_char' END,
 CASE WHEN contains(text, '```') THEN 'fence' END, CASE WHEN {_phrases('doc')} THEN 'meta' END], lambda x: x IS NOT NULL)) AS reason FROM documents LEFT JOIN m USING (doc_id))
SELECT reason, count(*) AS n FROM f GROUP BY 1""",
)
def job02(spark, d):
    from docq.operators.agg import reason_counts
    from docq.plans.jobs import validate

    return reason_counts(validate(t(spark, d, "documents"), "text"), "flags")
