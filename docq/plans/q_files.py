"""Queries of readers and writers: the given tables written as files, and what is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docq.operators import reshape
from docq.operators.lineage import folder
from docq.plans import jobs
from docq.plans.catalog import BOXES, boxes, query, responses, t
from docq.sources import io
from docq.sources.io import named_files


@query("src01_jsonl", "SELECT doc_id, 'a' || chr(8232) || lang || chr(133) || source || chr(10) || 'x' AS text FROM documents")
def src01(spark: SparkSession, d: str) -> DataFrame:
    """Records that hold other line separators than the line feed, which is escaped."""
    path = folder(spark, "jsonl")
    text = F.concat(F.lit("a\u2028"), "lang", F.lit("\u0085"), "source", F.lit("\nx"))
    t(spark, d, "documents").select("doc_id", text.alias("text")).write.json(path)
    return io.read_jsonl(spark, path, "doc_id long, text string")


@query(
    "src02_docs",
    """SELECT 'good' AS kind, s_suppkey, s_name, CAST(count(*) AS BIGINT) AS n FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY ALL
UNION ALL SELECT CASE WHEN s_suppkey % 14 = 0 THEN 'cut' ELSE 'empty' END, NULL, NULL, count(*) FROM supplier WHERE s_suppkey % 7 = 0 GROUP BY 1""",
)
def src02(spark, d):
    """A JSON document a file; some are cut off or empty, and counted."""
    path, s = folder(spark, "docs"), t(spark, d, "supplier")
    whole = F.to_json(F.struct("s_suppkey", "s_name"), {"pretty": "true"})
    body = F.when(F.col("s_suppkey") % 14 == 0, F.substring(whole, 1, 20)).when(F.col("s_suppkey") % 7 == 0, "").otherwise(whole)
    name = F.concat(F.col("s_suppkey").cast("string"), F.lit(".json"))
    named_files(s.select((F.col("s_nationkey") % 5).cast("string").alias("folder"), name.alias("name"), body.alias("text")), path)
    good, corrupt = io.read_docs(spark, path, "s_suppkey long, s_name string")
    kind = F.when(F.trim(F.replace("_corrupt_record", F.lit("\n"), F.lit(""))) == "", "empty").otherwise("cut")
    lost = corrupt.select(kind.alias("kind"), F.lit(None).cast("long").alias("s_suppkey"), F.lit(None).cast("string").alias("s_name"))
    rows = good.select(F.lit("good").alias("kind"), "s_suppkey", "s_name").unionByName(lost)
    return rows.groupBy("kind", "s_suppkey", "s_name").agg(F.count("*").alias("n"))


@query("src03_json_array", "SELECT n_nationkey, n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey")
def src03(spark, d):
    """Files that are one array of records each, a nation's customers."""
    path, c = folder(spark, "arrays"), t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    # A nation's customers are one file by the shape of the input, as the reader takes it.
    whole = c.groupBy("n_nationkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "c_custkey"))).alias("value"))
    whole.withColumn("folder", F.col("n_nationkey")).select("value", "folder").repartition("folder").write.partitionBy("folder").text(path)
    return io.read_json_array(spark, path, "n_nationkey long, n_name string, c_custkey long").select("n_nationkey", "n_name", "c_custkey")


@query(
    "src04_review_csv",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_size % 3 WHEN 0 THEN 'parser' ELSE 'model' END AS verdict, p_name || ', "' || p_brand || '"' AS correct, CAST(1 AS BIGINT) AS n FROM part WHERE p_partkey % 10 > 1
UNION ALL SELECT 'corrupt', CASE WHEN p_partkey % 20 = 0 THEN 'more' ELSE 'fewer' END, NULL, count(*) FROM part WHERE p_partkey % 10 = 0 GROUP BY 2""",
)
def src04(spark, d):
    """A review sheet with a byte order mark, empty verdicts, and lines of more or fewer cells."""
    path, p = folder(spark, "review"), t(spark, d, "part")
    quoted = F.concat(F.lit('"'), "p_name", F.lit(', \\"'), "p_brand", F.lit('\\""'))
    verdict = F.when(F.col("p_partkey") % 10 == 1, " ").when(F.col("p_size") % 3 == 0, "parser").otherwise("model")
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), verdict, quoted)
    broken = F.when(F.col("p_partkey") % 20 == 0, F.concat_ws(",", line, F.lit("more"))).otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(",fewer")))
    lines = p.select(F.when(F.col("p_partkey") % 10 == 0, broken).otherwise(line).alias("value"))
    # Every file has the header, as sheets of one kind in a folder do.
    lines.select(F.col("value").alias("\ufeffid,verdict,correct")).write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path)
    good, corrupt = io.scan_review_csv(spark, path)
    kind = F.when(F.col("_corrupt_record").contains("more"), "more").otherwise("fewer")
    lost = corrupt.groupBy(kind.alias("verdict")).agg(F.count("*").alias("n"))
    return good.select("id", "verdict", "correct", F.lit(1).cast("long").alias("n")).unionByName(lost.select(F.lit("corrupt").alias("id"), "verdict", F.lit(None).cast("string").alias("correct"), "n"))


@query("src06_field_texts", "SELECT 'IMG' || s_suppkey AS doc_id, 'Name' AS field, s_name AS value FROM supplier UNION ALL SELECT 'IMG' || s_suppkey, 'Total', CAST(s_nationkey AS VARCHAR) FROM supplier")
def src06(spark, d):
    """Files IMG1_Field.txt over the folders of two splits; Other is not asked for."""
    path, s = folder(spark, "fields"), t(spark, d, "supplier")
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"))
    rows = s.select("s_suppkey", F.inline(F.array(pair("Name", F.col("s_name")), pair("Total", F.col("s_nationkey")), pair("Other", F.lit("x")))))
    name = F.concat(F.lit("IMG"), F.col("s_suppkey").cast("string"), F.lit("_"), "field", F.lit(".txt"))
    named_files(rows.select(F.when(F.col("s_suppkey") % 4 == 0, "test").otherwise("train").alias("folder"), name.alias("name"), F.col("value").alias("text")), path)
    return io.read_field_texts(spark, path, ("Name", "Total"))


@query("src12_inventory", "SELECT 'txt' AS ext, count(*) AS files, CAST(sum(length(s_name) + 1) AS BIGINT) AS bytes FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'json', count(*), CAST(sum(length(s_name) + 1) AS BIGINT) FROM supplier WHERE s_suppkey % 3 = 0")
def src12(spark, d):
    path, s = folder(spark, "inventory"), t(spark, d, "supplier")
    name = F.concat(F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, ".JSON").otherwise(".txt"))
    named_files(s.select((F.col("s_nationkey") % 3).cast("string").alias("folder"), name.alias("name"), F.col("s_name").alias("text")), path)
    return io.inventory(spark, path)


@query("src13_registry", "SELECT p_name AS dataset_name, p_size AS sample_count FROM part")
def src13(spark, d):
    """A registry whose first record is a comment."""
    path, p = folder(spark, "registry"), t(spark, d, "part")
    comment = spark.createDataFrame([("registry of parts",)], "_comment string")
    p.select(F.col("p_name").alias("dataset_name"), F.col("p_size").alias("sample_count")).unionByName(comment, allowMissingColumns=True).write.json(path)
    return io.read_registry(spark, path).select("dataset_name", F.col("sample_count").cast("int").alias("sample_count"))


@query("snk01_samples", "SELECT conv_id, turn, role, length(text) AS chars, false AS internal, NULL AS meta FROM conversations UNION ALL SELECT conv_id, turn, role, length(text), false, 'kept' FROM conversations WHERE conv_id % 5 = 0")
def snk01(spark, d):
    """Training samples without internal columns and meta; evaluation samples with meta."""
    path, c = folder(spark, "samples"), t(spark, d, "conversations").withColumn("_draw", F.lit(1)).withColumn("meta", F.lit("kept"))
    io.write_samples(c, f"{path}/train")
    io.write_samples(c.where("conv_id % 5 = 0"), f"{path}/eval", keep_meta=True)
    train, held = spark.read.json(f"{path}/train"), spark.read.json(f"{path}/eval")
    shown = lambda df: df.select("conv_id", "turn", "role", F.length("text").alias("chars"), F.lit("_draw" in df.columns).alias("internal"), (F.col("meta") if "meta" in df.columns else F.lit(None).cast("string")).alias("meta"))
    return shown(train).unionByName(shown(held))


@query("snk02_taxonomy_tree", "SELECT o_orderstatus AS domain, o_orderpriority AS sub_domain, 'set' || o_custkey % 3 AS dataset_name, CASE WHEN o_orderkey % 2 = 0 THEN 'ocr' ELSE 'vqa' END AS task_category, o_orderkey FROM orders")
def snk02(spark, d):
    path, o = folder(spark, "tree"), t(spark, d, "orders")
    rows = o.select(
        F.col("o_orderstatus").alias("domain"), F.col("o_orderpriority").alias("sub_domain"), F.concat(F.lit("set"), (F.col("o_custkey") % 3).cast("string")).alias("dataset_name"),
        F.when(F.col("o_orderkey") % 2 == 0, "ocr").otherwise("vqa").alias("task_category"), "o_orderkey",
    )
    io.write_taxonomy_tree(rows, path, rows_per_file=200)
    # The schema is known; Spark would read every file once more to find it.
    return spark.read.schema(rows.schema).json(path).select(*io.TREE, "o_orderkey")


@query("snk03_splits", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split, lang AS tier, doc_id, text FROM documents")
def snk03(spark, d):
    path, docs = folder(spark, "splits"), t(spark, d, "documents")
    last = F.col("doc_id") % 10
    split = F.when(last == 0, "test").when(last == 1, "val").otherwise("train")
    io.write_splits(docs.select(split.alias("split"), F.col("lang").alias("tier"), "doc_id", "text"), "split", "tier", path, rows_per_file=150)
    return spark.read.json(path).select("split", "tier", "doc_id", "text")


@query(
    "snk06_package",
    f"""WITH {BOXES}, p AS (SELECT doc, count(*) AS n, CASE WHEN count(*) < 2 THEN 'few_boxes' WHEN max(x1) > 690 THEN 'wide' END AS reason FROM boxes GROUP BY 1),
x AS (SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) AS excluded FROM (SELECT reason, count(*) AS n FROM p WHERE reason IS NOT NULL GROUP BY 1))
SELECT count(*) AS count, median(n) AS median_size, any_value(excluded) AS excluded FROM p, x WHERE reason IS NULL""",
)
def snk06(spark, d):
    p = boxes(spark, d).groupBy("doc").agg(F.count("*").alias("n"), F.when(F.count("*") < 2, "few_boxes").when(F.max("x1") > 690, "wide").alias("reason"))
    m = io.package_manifest(p.where("reason is null"), "n", p.where("reason is not null"), "reason")
    said = F.transform(F.array_sort(F.map_entries("excluded")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return m.select("count", "median_size", F.array_join(said, ",").alias("excluded"))


@query(
    "snk08_backup",
    """SELECT 'current' AS version, p_partkey, upper(p_name) || '!' AS p_name, CAST(2 AS BIGINT) AS held FROM part WHERE p_size > 10 UNION ALL SELECT 'backup', p_partkey, p_name, 2 FROM part""",
)
def snk08(spark, d):
    """A table overwritten twice: its first state is kept, the one between is not."""
    path, p = folder(spark, "backup"), t(spark, d, "part").select("p_partkey", "p_name", "p_size")
    io.write_versioned(p, path)
    io.write_versioned(io.read_current(spark, path).where("p_size > 10").withColumn("p_name", F.upper("p_name")), path)
    io.write_versioned(io.read_current(spark, path).withColumn("p_name", F.concat("p_name", F.lit("!"))), path)
    io.drop_between(spark, path)
    held = F.lit(len(io.versions(spark, path))).cast("long").alias("held")
    both = {"current": io.read_current(spark, path), "backup": io.read_backup(spark, path)}
    parts = [df.select(F.lit(v).alias("version"), "p_partkey", "p_name", held) for v, df in both.items()]
    return parts[0].unionByName(parts[1])


@query(
    "job13_upload_mix",
    """WITH s AS (SELECT o_orderkey AS doc, row_number() OVER (ORDER BY md5('0|' || o_orderkey), o_orderkey) AS r FROM orders WHERE o_orderstatus = 'P'),
l AS (SELECT o_orderkey AS doc, row_number() OVER (ORDER BY md5('0|' || o_orderkey), o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O'),
has AS (SELECT DISTINCT l_orderkey AS doc FROM lineitem)
SELECT 'small' AS source, CASE WHEN r <= 10 THEN 'val' ELSE 'train' END AS split, unnest(CASE WHEN r <= 10 THEN [1] ELSE [1, 2, 3] END) AS copy, doc, doc IN (SELECT doc FROM has) AS regenerated FROM s
UNION ALL SELECT 'large', CASE WHEN r <= 70 THEN 'val' ELSE 'train' END, 1, doc, false FROM l WHERE r <= 70 + 300""",
)
def job13_upload(spark, d):
    """The whole mix: validation rows first, the small source repeated, its answers anew from blocks."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), "o_orderstatus", F.array(F.concat(F.col("o_orderkey").cast("string"), F.lit(".png"))).alias("images"), F.col("o_orderpriority").alias("answer"))
    blocks = reshape.blocks(reshape.pages(responses(spark, d), "doc", "body")[0], "doc")
    inventory = o.select(F.col("images")[0].alias("ref"))
    mix, _, _ = jobs.upload_mix(o.where("o_orderstatus = 'P'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'").drop("o_orderstatus"), blocks, inventory, "doc", repeat=3, n_large=300, val=80)
    return mix.select("source", "split", "copy", "doc", "regenerated")
