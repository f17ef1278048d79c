"""Nested parser output and documents to flat tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = """struct<width:double,height:double,
 parsing_res_list:array<struct<block_label:string,block_content:string,block_bbox:string,block_id:int,block_order:int,group_id:int>>,
 layout_det_res:struct<boxes:array<struct<cls_id:int,label:string,score:double,coordinate:array<double>>>>>"""
RESPONSE = f"struct<result:struct<elements:array<struct<json:{PAGE}>>>>"


def pages(responses: DataFrame, doc: str, body: str) -> tuple[DataFrame, DataFrame]:
    """(pages, reasons): the first element's page, or a bare page; what has none
    says no_page_json or no_size.  Broken JSON is no page."""
    page = F.coalesce(F.from_json(body, RESPONSE)["result"]["elements"][0]["json"], F.from_json(body, PAGE))
    # A generator keeps later filters and columns from reading the JSON again, once each.
    d = responses.select(doc, F.explode(F.array(page)).alias("page"))
    none = F.col("page.parsing_res_list").isNull() & F.col("page.layout_det_res").isNull()
    reason = F.when(F.col("page").isNull() | none, "no_page_json").when(F.col("page.width").isNull() | F.col("page.height").isNull(), "no_size")
    d = d.withColumn("reason", reason)
    return d.where("reason is null").select(doc, "page.*"), d.where("reason is not null").select(doc, "reason")


def blocks(pages_: DataFrame, doc: str) -> DataFrame:
    """One row a block: pos (array place), label, content, bbox, and the order key."""
    b = pages_.select(doc, F.posexplode("parsing_res_list").alias("pos", "b"))
    from docq.functions.geom import as_bbox

    return b.select(
        doc, "pos", F.col("b.block_label").alias("label"), F.col("b.block_content").alias("content"), as_bbox(F.col("b.block_bbox")).alias("bbox"),
        F.coalesce("b.block_order", "b.block_id", F.lit(0)).alias("order_key"),
    )


def boxes(pages_: DataFrame, doc: str, min_score: float = 0.0) -> DataFrame:
    b = pages_.select(doc, F.posexplode("layout_det_res.boxes").alias("pos", "b")).where(F.col("b.score") >= min_score)
    return b.select(doc, "pos", F.col("b.label").alias("label"), F.col("b.score").alias("score"), *[F.col("b.coordinate")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def fields_long(docs: DataFrame, doc: str, fields: str, skip_suffix: str = "__num") -> DataFrame:
    return docs.select(doc, F.explode(fields).alias("field", "value")).where(~F.col("field").endswith(skip_suffix))


def items_long(docs: DataFrame, doc: str, items: str) -> DataFrame:
    return docs.select(doc, F.posexplode(items).alias("idx", "i")).select(doc, "idx", "i.*")


def flatten_sections(docs: DataFrame, doc: str, sections: dict[str, str]) -> DataFrame:
    """fields: section.key of every map column, and section.key__num where the value is a number.
    sections: name by map column."""
    from docq.functions.num import to_num

    maps = []
    for col, name in sections.items():
        maps.append(F.map_from_entries(F.transform(F.map_entries(col), _entry(name, ""))))
        numbers = F.filter(F.map_entries(col), lambda e: e["value"].rlike(r"^[0-9.,\s-]*[0-9][0-9.,\s-]*$"))
        maps.append(F.map_from_entries(F.transform(numbers, _entry(name, "__num", to_num))))
    return docs.select(doc, F.map_concat(*maps).alias("fields"))


def _entry(section: str, suffix: str, value=lambda v: v):
    return lambda e: F.struct(F.concat(F.lit(f"{section}."), e["key"], F.lit(suffix)).alias("key"), value(e["value"]).cast("string").alias("value"))


#: Names of fields up to which their list is broadcast.
ALIASES = 100_000


def unify_fields(docs: DataFrame, doc: str, fields: str, alias: DataFrame) -> DataFrame:
    """Fields under their common names.  alias: key, common; of
    several keys of one name the largest value; keys without a name go.

    Rows do not meet by key, of which there are few and each may hold any share of the rows: a
    list of at most ALIASES names, counted first, is broadcast."""
    if alias.limit(ALIASES + 1).count() <= ALIASES:
        alias = F.broadcast(alias)
    long = docs.select(doc, F.explode(fields).alias("key", "value")).where(F.trim("value") != "")
    one = long.join(alias, "key").groupBy(doc, "common").agg(F.max("value").alias("value"))
    return one.groupBy(doc).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("common", "value")))).alias("fields"))


def get_field(fields: Column, keys: list[str]) -> Column:
    """The value of the first key that is neither null nor empty."""
    return F.coalesce(*[F.nullif(fields[k], F.lit("")) for k in keys])


def answer(messages: Column) -> Column:
    """Content of the first assistant message."""
    return F.get(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(0))["content"]


def prompt(messages: Column, mark: str = "<image>") -> Column:
    """Content of the first user message without image marks."""
    return F.trim(F.replace(F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"], F.lit(mark), F.lit("")))


def messages(turns: DataFrame, conv: str) -> DataFrame:
    """conv, messages (role, content) in the order of turns."""
    m = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(conv).agg(m.alias("m")).select(conv, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def reroot(df: DataFrame, path: str, prefixes: DataFrame) -> DataFrame:
    """new_path under the prefix of its first segment; unmapped roots get null.
    prefixes: root, prefix (an empty prefix keeps the path)."""
    j = df.withColumn("root", F.element_at(F.split(path, "/"), 1)).join(prefixes, "root", "left")
    return j.withColumn("new_path", F.when(F.col("prefix") == "", F.col(path)).otherwise(F.concat_ws("/", F.when(F.col("prefix").isNotNull(), F.col("prefix")), F.col(path)))).withColumn(
        "new_path", F.when(F.col("prefix").isNotNull(), F.col("new_path"))
    )


def unpivot_models(df: DataFrame, ids: list[str], models: dict[str, str]) -> DataFrame:
    """Long predictions from one struct column a model; absent structs make no row.  models: column by name."""
    arr = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"{c}.pred").alias("pred"), F.col(f"{c}.sec").cast("double").alias("sec"), F.col(c).isNotNull().alias("there")) for n, c in models.items()])
    return df.select(*ids, F.inline(arr)).where("there").drop("there")


def to_v2(rows: DataFrame, packages: DataFrame, version: str) -> DataFrame:
    """Taxonomy records: package attributes joined, an id of name, document and
    task, the number of user turns, and what is left over in `extra`."""
    from docq.functions.ids import record_id

    j = rows.join(packages, "package")
    return j.select(
        record_id(F.col("dataset_name"), F.col("doc_id"), F.col("task")).alias("id"), "doc_id", "dataset_name", "domain", "task", F.lit(version).alias("version"),
        F.size(F.filter("messages", lambda m: m["role"] == "user")).alias("num_turns"), "extra",
    )


def build_markdown(blocks_: DataFrame, doc: str, skip: tuple[str, ...], h1: tuple[str, ...], h2: tuple[str, ...]) -> DataFrame:
    """doc, markdown: blocks by order key, joined by blank lines; titles marked,
    tables kept as compact HTML, skipped labels and described (not read) blocks left out."""
    from docq.functions import text as t
    from docq.operators.rules import META_BLOCK, RISING

    content = F.trim(t.strip_fence(F.col("content")))
    told = content.rlike("(?i)" + "|".join(META_BLOCK)) | content.rlike(f"{RISING}{{6,}}")
    one_line = F.regexp_replace(content, "\n", " ")
    part = (
        F.when(content.contains("<table") | content.contains("<td"), t.compact_html(content)).when(F.col("label").isin(*h1), F.concat(F.lit("# "), one_line))
        .when(F.col("label").isin(*h2), F.concat(F.lit("## "), one_line)).otherwise(content)
    )
    rows = blocks_.where((content != "") & ~F.coalesce(F.col("label"), F.lit("text")).isin(*skip) & ~told).select(doc, "order_key", "pos", part.alias("part"))
    return rows.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("order_key", "pos", "part"))).alias("p")).select(doc, F.array_join("p.part", "\n\n").alias("markdown"))


def replace_page(responses: DataFrame, reviewed: DataFrame, doc: str) -> DataFrame:
    """Responses with the reviewed markdown in place of their own; others unchanged."""
    return responses.join(reviewed.select(doc, F.col("markdown").alias("new_")), doc, "left").withColumn("markdown", F.coalesce("new_", "markdown")).drop("new_")


def expand_tasks(docs: DataFrame, doc: str, answers: dict[str, Column]) -> DataFrame:
    """A row for each task that a document can answer: doc, task, answer."""
    each = F.array(*[F.struct(F.lit(t).alias("task"), a.cast("string").alias("answer")) for t, a in answers.items()])
    return docs.select(doc, F.inline(F.filter(each, lambda x: x["answer"].isNotNull() & (x["answer"] != ""))))


def to_v0(df: DataFrame, dataset: str, question: str, doc: str, answer_col: str) -> DataFrame:
    """Taxonomy records of the first version: constants, the answer and its language."""
    from docq.functions.text import detect_language

    return df.select(
        F.lit(dataset).alias("dataset_name"), F.lit("0").alias("version"), F.struct(F.lit("OCR").alias("category_1"), F.lit("Document Understanding").alias("category_2")).alias("task"),
        F.struct(F.lit("Other").alias("category_1")).alias("domain"), F.struct(F.lit(1).alias("image_cnt"), F.col(doc).cast("string").alias("source_file")).alias("metadata"),
        F.struct(F.lit(question).alias("question")).alias("prompt"), F.struct(F.col(answer_col).alias("chosen")).alias("completion"), detect_language(F.col(answer_col)).alias("language"),
    )


def labeling_upload(blocks_: DataFrame, doc: str, sx: float, sy: float, w: float, h: float) -> DataFrame:
    """Blocks for a labelling tool: boxes scaled to the image and clipped, orders
    made gapless, and what is wrong with a block in errors.  blocks_: doc, pos,
    order_key, x1, y1, x2, y2."""
    from pyspark.sql import Window

    from docq.functions import geom

    b = geom.rescale(geom.box(), F.lit(sx), F.lit(sy), F.lit(w), F.lit(h))
    out = blocks_.withColumns(dict(zip(("x1", "y1", "x2", "y2"), b, strict=True)))
    errors = F.array_compact(F.array(F.when(F.col("x2") <= F.col("x1"), "no_width"), F.when(F.col("y2") <= F.col("y1"), "no_height")))
    return out.withColumn("order", F.row_number().over(Window.partitionBy(doc).orderBy("order_key", "pos")) - 1).withColumn("errors", errors)


def crop_manifest(boxes_: DataFrame, doc: str, idx: str, label: str, routes: DataFrame, w: int, h: int, ratio: float, min_pad: float) -> tuple[DataFrame, DataFrame]:
    """(crops, drops): the padded region of every box whose label has a task, and
    the others with a reason (unrouted, too_small)."""
    from docq.functions import geom
    from docq.operators.rules import route_labels

    b = geom.pad_crop(geom.box(), F.lit(w), F.lit(h), ratio, min_pad)
    d = route_labels(boxes_, label, routes).withColumns({f"c{n}": c for n, c in zip(("x1", "y1", "x2", "y2"), b, strict=True)})
    reason = F.when(F.col("task") == "unknown", "unrouted").when(F.col("cx1").isNull(), "too_small")
    d = d.withColumn("reason", reason)
    return d.where("reason is null").select(doc, idx, "task", "cx1", "cy1", "cx2", "cy2"), d.where("reason is not null").select(doc, idx, "reason")
