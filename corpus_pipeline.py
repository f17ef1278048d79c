"""The corpus pipeline: each stage works on what the one before it kept.

run(spark, sf_dir) applies STAGES to the documents table; each stage's result is
written and read again before the next.  No stage is expressible in SQL as a
whole (toxicity is a fitted model), so ORACLE_SQL is None.  tests/llm/test_pipeline.py
holds run() against a plain version of every stage on a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docq.llm import decontam, minhash, packing, secret_scan, toxicity
from docq.llm.scratch import Scratch, bounded, skew_join

TOXIC = 0.7


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; the classifier is fitted to
    the labelled ones among them.  Null and empty texts have the score of a text
    without features; without labels every score is 0.5, and all rows stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_of(F.col("text"), model) < TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the smallest doc_id
    (of several of its texts under it, the one of smallest key).  Shingles of five
    words, similarity of 0.8 or more.  Texts under one doc_id that no links join
    are components of their own.

    Of repeated rows, equal in doc_id and text, one stays.  Rows without words or
    without a doc_id are in no component, so all of them stay.
    """
    scratch = Scratch(spark, "copies")
    found = minhash.near_duplicates(docs, shingle_words=5, threshold=0.8).where("cluster is not null")
    rows = scratch.table(found.groupBy("doc_id", "key", "cluster").agg(F.count("*").alias("rows")), "rows")
    first = rows.groupBy("cluster").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("held"), F.max("rows").alias("most"))
    first = scratch.table(first.where("held > 1 or most > 1").drop("most"), "components")
    judged = skew_join(rows, first, "cluster", "held")
    judged = judged.withColumn("stays", (F.col("doc_id") == F.col("first.doc_id")) & (F.col("key") == F.col("first.key")))
    # (doc_id, key) that goes, or of which one row stays.
    judged = scratch.table(judged.where("not stays or rows > 1").select(F.col("doc_id").alias("d_"), F.col("key").alias("k_"), "stays"), "judged")
    same = (docs["doc_id"].cast("long") == judged["d_"]) & (decontam.text_key(docs) == judged["k_"])
    once = docs.join(bounded(judged.where("stays")), same, "left_semi")
    order = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    once = once.groupBy("doc_id", decontam.text_key(docs).alias("k_")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("r_")).select("r_.*")
    return docs.join(bounded(judged), same, "left_anti").unionByName(_like(once, docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.  Rows without words,
    repeated rows and rows without a doc_id are judged alike, by their texts."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark, and n_chars, where docs
    has that column, set anew for them.  Null texts stay null."""
    _, ledger = secret_scan.scan(docs)
    hits = ledger.where("size(spans) > 0").select(F.col("blob").alias("blob_"), F.sort_array("spans").alias("spans_"))
    hits = Scratch(spark, "redact").table(hits, "hits")
    joined = docs.select(F.struct("*").alias("d_"), secret_scan.blob_of(docs["text"]).alias("b_")).join(bounded(hits), F.col("b_") == F.col("blob_"), "left")
    none, text = F.col("spans_").isNull(), F.col("d_.text")
    new = F.when(none, text).otherwise(secret_scan.redacted(text, F.col("spans_")))
    changed = {"text": new, "n_chars": F.when(none, F.col("d_.n_chars")).otherwise(F.length(new)) if "n_chars" in docs.columns else None}
    return joined.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"d_.`{c}`").alias(c) for c in docs.columns])


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bin and a place in it for each piece of each document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_bins),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
