"""A two-pass external shuffle into shards.

Pass 1 scatters records uniformly into buckets that fit in memory, by a seeded
hash of their id.  Pass 2 takes each bucket, puts it in a random order by
Fisher-Yates with a seed of its own, and writes it.  Buckets in order, each in
its own order, are one random order of all records; prefix sums of the bucket
counts place a record in it, and shards are equal stretches of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docq.llm.scratch import HOT_ROWS, Scratch, bounded, bounded_count


#: Buckets whose bases (two numbers each) may be broadcast: 100 TB in the default size.
MANY_BUCKETS = 4_000_000


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A random order of 0..n-1: each place swaps with one not after it."""
    rng = np.random.default_rng(seed)
    picks = (rng.random(max(n - 1, 0)) * np.arange(n, 1, -1)).astype(np.int64).tolist()
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), picks, strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _shuffled(seed: int):
    """Rows sorted by bucket, id; column 0 is the bucket, to which a slot is added."""

    def run(batches):
        held, at = [], None
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip([0, *cut], [*cut, len(bucket)], strict=True):
                if a == b:
                    continue
                if bucket[a] != at:
                    if held:
                        yield from done(held, at)
                    held, at = [], bucket[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from done(held, at)

    def done(held, at):
        t = pa.Table.from_batches(held)
        order = fisher_yates(t.num_rows, seed * 1_000_003 + int(at))
        t = t.take(pa.array(order)).append_column("bucket_slot", pa.array(np.arange(t.num_rows)))
        yield from t.to_batches(max_chunksize=2000)

    return run


def _dealt(scratch: Scratch, docs: DataFrame, seed: int, id_col: str, text_col: str, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Rows (bucket, doc_id, text), partitioned and sorted by bucket, and how many they are."""
    crc = F.crc32(F.col("text").cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("crc", crc)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    groups = scratch.table(rows.groupBy("doc_id", "crc").agg(F.count("*").alias("n"), F.sum(size).alias("size")), "groups")
    total = groups.agg(F.sum("size"), F.sum("n")).first()
    n, buckets = total[1] or 0, max(1, -(-(total[0] or 0) // bucket_bytes))
    # Null ids and repeated ids spread by their text, large groups of equal rows by the rows' places.
    hot = groups.where((F.col("n") > HOT_ROWS) | (F.col("n") > 1) & (F.col("size") > bucket_bytes // 4)).select(F.col("doc_id").alias("d_"), F.col("crc").alias("c_"), F.lit(True).alias("hot"))
    if not hot.isEmpty():
        rows = rows.join(bounded(hot), F.col("doc_id").eqNullSafe(F.col("d_")) & F.col("crc").eqNullSafe(F.col("c_")), "left")
        rows = rows.withColumn("salt", F.when(F.col("hot"), F.monotonically_increasing_id()))
    else:
        rows = rows.withColumn("salt", F.lit(None).cast("long"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "crc", "salt"), F.lit(buckets)).cast("int")
    return rows.select(bucket.alias("bucket"), "doc_id", "text", "crc").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "crc").drop("crc"), n


def external_shuffle(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20) -> DataFrame:
    """Write docs in a random order cut into shards, and read what was written.

    Returns doc_id, text, shard (0 to shards-1), slot (place in the shard,
    gapless from 0).  Counts of shards differ by one at most.  Order by shard
    and slot is the random order; equal input and seed give it again.

    bucket_bytes bounds what one task holds: a bucket of about that many bytes of
    text, and of one text where that is longer.  100 TB make 3 million buckets of the
    default size; give a larger one where executors have the memory.  Null texts stay null; null ids
    and repeated rows are records like others (rows that agree in id and text may
    trade places; where they are more than 1,000, or a quarter of a bucket together, they are
    dealt by their place in the input, not to one bucket); other columns are not
    read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    dealt, n = _dealt(scratch, docs, seed, id_col, text_col, bucket_bytes)
    written = scratch.table(dealt.mapInArrow(_shuffled(seed), "bucket int, doc_id long, text string, bucket_slot long"), "buckets")
    # One row a bucket: a bound by bytes of input over bucket_bytes.
    counts = written.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    bases = scratch.table(counts.select("bucket", before.alias("before")), "bases")
    bases = F.broadcast(bases) if bounded_count(bases, MANY_BUCKETS) else bases
    placed = written.join(bases, "bucket").withColumn("at", F.col("before") + F.col("bucket_slot"))
    # Shard s takes places ceil(s * n / shards) and on.
    placed = placed.withColumn("shard", F.expr(f"cast((at * {shards}L) div {max(n, 1)}L as int)"))
    begin = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return placed.select("doc_id", "text", "shard", (F.col("at") - begin).alias("slot"))
