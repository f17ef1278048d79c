"""Conflict-constrained best-fit packing of texts into bins of fixed size.

Texts are cut into pieces of at most `capacity`; a full piece is a bin by
itself.  The other pieces, one of each text, are dealt into shards by a hash of
id and text (and of their row, where very many rows agree in both), so that each
shard holds about `shard_rows` pieces however often a row repeats, and every shard
is packed in one task, largest first.  Open bins are kept ordered by residual space; each
carries a bitmap of the sources and one of the duplicate clusters inside it.
The search starts at the successor of the piece's size and goes on until the
tightest bin that conflicts in neither bitmap is found, else opens a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docq.llm.scratch import Scratch, bounded
from docq.llm.token_files import _encoder, steps


class Bins:
    """Open bins in order of residual space.

    Bins of one residual and one source bitmap form a class, so a search steps
    over classes, not over every bin that a frequent source already fills.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[int] = []  # residuals that have bins, ascending
        self.at: dict[int, dict[int, dict[int, int]]] = {}  # residual -> sources -> bin -> clusters
        self.made = 0
        self.residual: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and start inside it for a piece; source and cluster are bits (0: none)."""
        for i in range(bisect_left(self.order, size), len(self.order)):
            residual = self.order[i]
            groups = self.at[residual]
            best = None
            for sources, bins in groups.items():
                if sources & source:
                    continue
                for b, clusters in bins.items():
                    if not clusters & cluster:
                        if best is None or b < best[0]:
                            best = (b, sources, clusters)
                        break
            if best:
                b, sources, clusters = best
                self._take(residual, sources, b, i)
                self._put(residual - size, sources | source, b, clusters | cluster)
                return b, self.capacity - residual
        b = self.made
        self.made += 1
        self.residual.append(0)
        self._put(self.capacity - size, source, b, cluster)
        return b, 0

    def _put(self, residual: int, sources: int, b: int, clusters: int) -> None:
        if residual not in self.at:
            insort(self.order, residual)
            self.at[residual] = {}
        self.at[residual].setdefault(sources, {})[b] = clusters
        self.residual[b] = residual

    def _take(self, residual: int, sources: int, b: int, i: int) -> None:
        groups = self.at[residual]
        del groups[sources][b]
        if not groups[sources]:
            del groups[sources]
        if not groups:
            del self.at[residual]
            del self.order[i]


def pack_shard(rows: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each (size, source, cluster), in the given order."""
    bins, bits, held = Bins(capacity), {}, {}
    for _, _, c in rows:
        if c is not None:
            held[c] = held.get(c, 0) + 1
    shared = {c: i for i, c in enumerate(c for c, n in held.items() if n > 1)}
    out = []
    for size, source, cluster in rows:
        s = 0 if source is None else 1 << bits.setdefault(source, len(bits))
        out.append(bins.place(size, s, 1 << shared[cluster] if cluster in shared else 0))
    return out


def _pack(capacity: int):
    """Rows (shard, size, row, doc_id, piece, start, source, cluster) sorted by shard, size descending."""

    def run(batches):
        held, at = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != at:
                    if held:
                        yield packed(held)
                    held, at = [], row[0]
                held.append(row)
        if held:
            yield packed(held)

    def packed(rows):
        where = pack_shard([(r[1], r[6], r[7]) for r in rows], capacity)
        cols = [
            pa.array([r[0] for r in rows], pa.int32()), pa.array([b for b, _ in where], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
            pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([s for _, s in where], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["shard", "bin", "doc_id", "piece", "text_start", "length", "bin_start", "row"])

    return run


def _places(scratch: Scratch, rows: DataFrame, capacity: int, shard_rows: int) -> DataFrame:
    """A bin and a place in it for each piece of rows (row, doc_id, s, cluster, key, n), a written table."""
    full = F.floor(F.col("n") / capacity)
    rest = rows.where((F.col("n") % capacity > 0) | (F.col("n") == 0))
    shards = max(1, -(-rest.count() // shard_rows))
    # Equal rows share a shard, in which they may trade places, unless they would fill much of it.
    hot = rest.groupBy("doc_id", "key").agg(F.count("*").alias("held")).where(F.col("held") > max(1, shard_rows // 8))
    hot = scratch.table(hot.select(F.col("doc_id").alias("d_"), F.col("key").alias("k_"), "held"), "repeated")
    rest = rest.join(bounded(hot), F.col("doc_id").eqNullSafe(F.col("d_")) & F.col("key").eqNullSafe(F.col("k_")), "left")
    salt = F.when(F.col("held").isNotNull(), F.col("row"))
    shard = F.pmod(F.xxhash64("doc_id", "key", salt, F.lit(17)), F.lit(shards)).cast("int")
    pieces = rest.select(shard.alias("shard"), (F.col("n") % capacity).alias("size"), "row", "doc_id", full.alias("piece"), (full * capacity).alias("start"), F.col("s").alias("source"), "cluster", "key")
    packed = (
        pieces.repartition(shards, "shard")
        .sortWithinPartitions("shard", F.desc("size"), "doc_id", "key", "source", "cluster", "row")
        .drop("key")
        .mapInArrow(_pack(capacity), "shard int, bin long, doc_id long, piece long, text_start long, length long, bin_start long, row long")
    )
    # Full pieces are whole bins: the row's, in a shard below zero for each piece.
    whole = rows.where(full > 0).select("row", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), full.cast("long") - 1)).alias("piece"))
    whole = whole.select(
        (F.lit(-1) - F.col("piece")).cast("int").alias("shard"), F.col("row").alias("bin"), "doc_id", "piece", (F.col("piece") * capacity).alias("text_start"),
        F.lit(capacity).cast("long").alias("length"), F.lit(0).cast("long").alias("bin_start"), "row",
    )
    return packed.unionByName(whole)


def _named(docs: DataFrame, id_col: str, text_col: str, source_col: str, cluster_col: str | None) -> DataFrame:
    """docs with what packing needs: row, doc_id, s, cluster, key (of the text)."""
    cluster = F.xxhash64(F.col(text_col)) if cluster_col is None else F.xxhash64(F.col(cluster_col))
    source = F.when(F.col(source_col).isNotNull(), F.xxhash64(F.col(source_col).cast("string")))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), source.alias("s"), cluster.alias("cluster"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def pack(
    docs: DataFrame,
    capacity: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    shard_rows: int = 8192,
) -> DataFrame:
    """A bin and a place in it for every piece of every text.

    Returns shard, bin (unique within its shard), doc_id, piece, text_start,
    length (code points of the text), bin_start (where the piece begins in its
    bin), row (which row of docs, by their order in its files; repeated rows have
    numbers of their own).  No bin exceeds `capacity`, and of pieces smaller than
    it no bin holds two of one source, of one duplicate cluster, or of one document.

    Bins hang on the rows' contents, not on how files or partitions split them: only of
    more than shard_rows / 8 rows that agree in id and text is each dealt by its place.

    cluster_col names the duplicate cluster; by default equal texts form one.
    Null and empty texts make one piece of length 0; a null source conflicts
    with nothing; repeated rows conflict as equal texts; a null id is kept.
    Other columns are not read.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = _named(docs, id_col, text_col, source_col, cluster_col).withColumn("n", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return _places(scratch, scratch.table(rows.drop("text"), "rows"), capacity, shard_rows)


def _ids(tokenizer_path: str, end_id: int | None):
    def run(batches):
        enc = _encoder(tokenizer_path)
        for batch in batches:
            for a, b in steps(batch.column(5)):
                piece = batch.slice(a, b - a)
                got = enc.encode([t or "" for t in piece.column(5).to_pylist()], end_id)
                off = np.concatenate(([0], np.cumsum([len(g) // enc.dtype.itemsize for g in got]))).astype(np.int32)
                flat = np.frombuffer(b"".join(got), enc.dtype).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(off), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*piece.columns[:5], ids, pa.array(np.diff(off).astype(np.int64))], names=["row", "doc_id", "s", "cluster", "key", "ids", "n"])

    return run


def pack_ids(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    shard_rows: int = 8192,
) -> DataFrame:
    """Bins of token ids: shard, bin, ids (at most `capacity` of them), pieces
    (bin_start, length, row, doc_id, piece, token_start; in order).

    Texts are encoded whole, with end_id after each where it is given, and cut at
    `capacity` ids; bins and their conflicts are those of pack.  A row's pieces in
    order are its ids again.  Null and empty texts add no ids but the end id.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    named = _named(docs, id_col, text_col, source_col, cluster_col)
    rows = scratch.table(named.mapInArrow(_ids(tokenizer_path, end_id), "row long, doc_id long, s long, cluster long, key long, ids array<int>, n long"), "ids")
    placed = _places(scratch, rows.drop("ids"), capacity, shard_rows).join(rows.select("row", "ids"), "row")
    cut = F.slice("ids", (F.col("text_start") + 1).cast("int"), F.col("length").cast("int"))
    piece = F.struct("bin_start", "length", "row", "doc_id", "piece", F.col("text_start").alias("token_start"), cut.alias("cut"))
    # A bin holds at most `capacity` ids, and pieces of no ids at most one of each source.
    bins = placed.groupBy("shard", "bin").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    pieces = F.transform("p", lambda x: x.dropFields("cut"))
    return bins.select("shard", "bin", F.flatten("p.cut").alias("ids"), pieces.alias("pieces"))
