"""Secrets, by an incremental ledger of content-addressed blobs.

Every version of every path is a blob named by the SHA-256 of its text.  A
ledger says which rule versions have seen a blob and what they found.  A run
scans each unseen (blob, rule version) pair once, however many paths and
versions hold the blob, appends to the ledger, and joins findings back to all
paths.  Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docq.llm.scratch import Scratch, skew_join
from docq.llm.spans import marked, match_spans, merged, of_kind


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, least length (of a group), version."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: str = "1"

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: Column) -> Column:
        if not self.least:
            return match_spans(text, self.pattern)
        return match_spans(text, self.pattern, lambda m: F.length(m if not self.group else F.regexp_extract(m, self.pattern, self.group)) >= self.least)


#: Base kinds, in the order in which spans of equal start are listed.  A run of
#: hex digits shorter than 24 is never kept, nor is an access key under 20.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0),
    Rule("forge", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}", 0),
)
RULES = BASE + EXTRA
LEDGER = "blob binary, scanned array<string>, spans array<struct<start:bigint,rank:int,end:bigint,kind:string,rule:string>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def by_rule(rule: Rule, order: int, text: Column) -> Column:
    """The rule's spans with its key."""
    return F.transform(of_kind(rule.kind, order, rule.spans(text)), lambda s: s.withField("rule", F.lit(rule.key)))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows) of all versions of all paths.

    versions: a path id and a text for each version; other columns are not read.
    findings: doc_id, blob, spans (start, rank, end, kind; by start, then order
    of rules), one row for each row of versions, found now or earlier by the
    given rule versions.  ledger: rows that earlier runs returned; its spans also
    name the rule version that found them, and those of other versions stay out.

    Null text is the empty blob; a null id is kept; repeated rows and equal
    texts share a blob, scanned once.  An empty table gives empty results.
    """
    scratch = Scratch(versions.sparkSession, "secrets")
    text = versions.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("blob", blob_of(F.col("text")))
    paths = scratch.table(text.select("id", "blob"), "paths")
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = paths.groupBy("blob").agg(F.min("id").alias("carrier"), F.count("*").alias("held"))
    if ledger is None:
        todo = blobs.withColumn("rules", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("rules", F.when(F.col("seen").isNull(), wanted).otherwise(F.array_except(wanted, "seen"))).where("size(rules) > 0").drop("seen")
    todo = scratch.table(todo, "unseen")
    # Text moves once, from the one path of each unseen blob that stands for it; that of a blob
    # with very many rows, which may all be rows of that path, does not move at all.
    todo_ = todo.select(F.xxhash64("carrier", "blob").alias("at_"), F.col("carrier").alias("c_"), F.col("blob").alias("b_"), "rules", "held").hint("shuffle_hash")
    body = skew_join(text.withColumn("at_", F.xxhash64("id", "blob")), todo_, "at_", "held", few=0)
    body = body.where(F.col("id").eqNullSafe(F.col("c_")) & (F.col("blob") == F.col("b_")))
    found = [F.when(F.array_contains("rules", r.key), by_rule(r, i, F.col("text"))).otherwise(F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string,rule:string>>)")) for i, r in enumerate(rules)]
    hits = body.select("blob", reduce(F.concat, found).alias("spans")).where("size(spans) > 0").dropDuplicates(["blob"])
    hits = scratch.table(hits, "hits")
    fresh = todo.select("blob", F.col("rules").alias("scanned")).join(hits, "blob", "left")
    fresh = fresh.select("blob", "scanned", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string,rule:string>>)")).alias("spans"))
    held = hits
    if ledger is not None:
        current = F.filter("spans", lambda s: F.array_contains(wanted, s["rule"]))
        old = ledger.where(F.arrays_overlap("scanned", wanted)).select("blob", current.alias("spans"))
        held = held.union(old).where("size(spans) > 0").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    out = paths.join(held.withColumnRenamed("blob", "b_"), F.expr("blob = b_"), "left")
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string,rule:string>>)")
    return out.select(F.col("id").alias("doc_id"), "blob", F.transform(F.sort_array(F.coalesce("spans", none)), lambda s: s.dropFields("rule")).alias("spans")), fresh


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span replaced by a mark, spans that overlap by one together.  A null
    text stays null; null or empty spans leave it as it is."""
    return F.when(text.isNull() | (F.coalesce(F.size(spans), F.lit(0)) <= 0), text).otherwise(marked(text, merged(spans, touching=False), mark))
