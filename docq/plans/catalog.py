"""Where queries register, and the tables they derive from the given ones.

A derived table is written twice, as Spark SQL expressions and as a DuckDB CTE,
from the same columns of whole tables, so that it grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")

# Line items of an order, numbered: the boxes, cells and items of a page.
LINES = f"lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS idx FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").withColumn("idx", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)))


_X1, _Y1 = "CAST((l_partkey * 13) % 700 AS DOUBLE)", "CAST(idx * 40 + l_suppkey % 17 AS DOUBLE)"
_BOX = [
    "l_orderkey AS doc", "idx", f"{_X1} AS x1", f"{_Y1} AS y1", f"{_X1} + 60 + l_quantity * 4 AS x2", f"{_Y1} + 20 + l_linenumber AS y2", "l_returnflag AS label", "l_linestatus AS mark",
    "l_suppkey", "l_discount",
]
_PRED = ["doc", "idx", "x1 + l_suppkey % 23 - 5 AS x1", "y1 + l_suppkey % 5 - 2 AS y1", "x2 + l_suppkey % 29 - 9 AS x2", "y2 + l_suppkey % 3 AS y2", "label", "mark"]
_SEEN = "NOT (label = 'N' AND mark = 'O')"
BOXES = f"{LINES}, boxes AS (SELECT {', '.join(_BOX)} FROM lines), preds AS (SELECT {', '.join(_PRED)} FROM boxes WHERE {_SEEN})"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr(*_BOX)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as a detector might give them: moved a little, some missing."""
    return boxes(spark, sf_dir).where(_SEEN).selectExpr(*_PRED)


_SCORE = ["event_id", "user_id AS doc", "event_type AS model", "CASE WHEN user_id < 50 THEN 'text' ELSE 'table' END AS task", "value / 50.0 AS cer", "value < 10 AS ok", "value"]
SCORES = f"scores AS (SELECT {', '.join(_SCORE)} FROM events)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the scores of models on rows of documents."""
    return t(spark, sf_dir, "events").selectExpr(*_SCORE)


# Names of parts against a model's reading of them; several kinds of slips.
_READ = """CASE WHEN p_type = 'ECONOMY' THEN p_name WHEN p_type = 'STANDARD' THEN replace(p_name, 'e', 'c') WHEN p_type = 'PROMO' THEN upper(p_name)
 WHEN p_type = 'MEDIUM' THEN concat(p_name, ' ', p_brand) WHEN p_type = 'SMALL' THEN '' ELSE concat(p_name, '  ', CAST(p_size AS VARCHAR(10))) END"""
READS = f"reads AS (SELECT p_partkey AS id, p_brand AS model, p_type AS tier, concat(p_name, ' ', CAST(p_size AS VARCHAR(10))) AS gt, {_READ} AS pred FROM part)"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS model", "p_type AS tier", "concat(p_name, ' ', CAST(p_size AS STRING)) AS gt", f"{_READ} AS pred")


# An HTML table for each order, with attributes, sections and a column span.
_HEAD = '<tr><th>part</th><th class="h" colspan="2">qty</th><th>flag</th></tr>'
_ROW = ("<tr class=\"r\">\n<td align=\"left\">", "</td> <td style=\"x\" colspan=\"2\">", "</td><TD>", "</td></tr>")


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = [F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag")]
    row = F.concat(F.lit(_ROW[0]), cell[0], F.lit(_ROW[1]), cell[1], F.lit(_ROW[2]), cell[2], F.lit(_ROW[3]))
    rows = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("idx", row.alias("r")))).alias("rows"))
    html = F.concat(F.lit(f'<table border="1"><thead>{_HEAD}</thead>\n<tbody>'), F.array_join("rows.r", ""), F.lit("</tbody></table>"))
    return rows.select("doc", html.alias("html"))


# What is left of it in one spelling.
_CLEAN_HEAD = '<table><tr><td>part</td><td colspan="2">qty</td><td>flag</td></tr>'
CANON = f"""{LINES}, canon AS (SELECT l_orderkey AS doc, '{_CLEAN_HEAD}' || string_agg('<tr><td>' || l_partkey || '</td><td colspan="2">' || CAST(l_quantity AS INT) || '</td><td>' || l_returnflag || '</td></tr>', '' ORDER BY idx) || '</table>' AS html FROM lines GROUP BY 1)"""


# Parser responses: one JSON document for each order.
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.struct(
        F.when(F.col("label") == "A", "doc_title").when(F.col("label") == "R", "table").otherwise("text").alias("block_label"),
        F.concat(F.lit("part "), F.col("l_suppkey").cast("string")).alias("block_content"),
        F.to_json(F.array("x1", "y1", "x2", "y2")).alias("block_bbox"), F.col("idx").alias("block_id"),
        F.when(F.col("mark") == "F", F.col("idx") * 2).cast("int").alias("block_order"),
    )
    box = F.struct(F.lit(1).alias("cls_id"), "label", (F.col("l_discount") * 10).alias("score"), F.array("x1", "y1", "x2", "y2").alias("coordinate"))
    g = boxes(spark, sf_dir).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("idx", block.alias("b"), box.alias("d")))).alias("a"))
    page = F.struct(F.lit(1000.0).alias("width"), F.lit(2000.0).alias("height"), F.col("a.b").alias("parsing_res_list"), F.struct(F.col("a.d").alias("boxes")).alias("layout_det_res"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(page.alias("json"))).alias("elements")).alias("result")))
    return g.select("doc", body.alias("body"))


# An order as a document of fields and items (money in cents).
def kie_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    item = F.struct(F.col("l_partkey").cast("string").alias("name"), F.col("l_quantity").cast("bigint").alias("qty"), F.floor(cents / F.col("l_quantity")).alias("unit_price"), cents.alias("amount"))
    items = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("idx", item.alias("i")))).alias("a"), F.sum(cents).alias("item_total"))
    o = t(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    fields = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("date"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("note__num"), F.lit("1"))
    none = F.array().cast("array<struct<name:string,qty:bigint,unit_price:bigint,amount:bigint>>")
    return o.select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("source"), fields.alias("fields"), F.coalesce("a.i", none).alias("items"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total"), F.coalesce("item_total", F.lit(0)).alias("item_total"),
    )
