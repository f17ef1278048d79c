"""Approximate nearest neighbours with a hash-prefix forest.

Vectors are dealt into blocks of bounded size.  In a block each tree is the
array of the vectors' bit strings (signs of random projections) in sorted
order.  A query descends every tree to its longest prefix match; then all trees
ascend together, one bit at a time, until the vectors that share a prefix of
that length in some tree are enough candidates, which are compared exactly.
Every vector is indexed, and every query meets every block (a stated query set
against all rows, in blocks); a block's answers are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docq.llm.scratch import Scratch

BITS = 32


def evened(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose squares would overflow or vanish, divided by a power of two near their largest component: the cosine stays."""
    most = np.abs(vectors).max(axis=1, initial=0)
    odd = (most > 1e100) | (most < 1e-100)
    if not odd.any():
        return vectors
    out = vectors.copy()
    out[odd] = np.ldexp(vectors[odd], -np.frexp(most[odd])[1][:, None])
    return out


class Forest:
    """The sorted arrays of one block. vectors: (n, dim) doubles, none zero."""

    def __init__(self, vectors: np.ndarray, trees: int, seed: int = 7):
        vectors = evened(vectors)
        self.vectors, self.norms = vectors, np.linalg.norm(vectors, axis=1)
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * BITS)).astype(np.float32)
        codes = self.codes(vectors / self.norms[:, None])
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=0)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """The bit strings of unit vectors, one column a tree."""
        bits = (unit.astype(np.float32) @ self.planes > 0).reshape(len(unit), -1, BITS)
        return (bits * (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query (unit vectors), the candidates' indices."""
        codes = self.codes(queries)
        q, trees = codes.shape
        lo, hi = np.zeros((q, trees), np.int64), np.zeros((q, trees), np.int64)
        open_ = np.arange(q)
        for depth in range(BITS, -1, -1):
            width = np.uint64(BITS - depth)
            low = (codes[open_] >> width) << width
            high = low + (np.uint64(1) << width)
            for t in range(trees):
                lo[open_, t] = np.searchsorted(self.sorted[:, t], low[:, t], "left")
                hi[open_, t] = np.searchsorted(self.sorted[:, t], high[:, t], "left")
            open_ = open_[(hi[open_] - lo[open_]).sum(axis=1) < enough]
            if not len(open_):
                break
        seen = np.zeros(len(self.vectors), dtype=bool)
        for i in range(q):
            seen[:] = False
            for t in range(trees):
                seen[self.order[lo[i, t] : hi[i, t], t]] = True
            yield np.flatnonzero(seen)

    def search(self, queries: np.ndarray, k: int, enough: int):
        """For each query, indices and cosines of at least its k best candidates; all that tie with the last."""
        queries = evened(queries)
        norms = np.linalg.norm(queries, axis=1)
        for i, c in enumerate(self.candidates(queries / norms[:, None], enough)):
            cos = (self.vectors[c] @ queries[i]) / (self.norms[c] * norms[i])
            if len(c) > k:
                least = np.partition(cos, len(c) - k)[len(c) - k]
                keep = cos >= least - 1e-12
                c, cos = c[keep], cos[keep]
            yield c, cos


def _answers(k: int, trees: int, share: float, least: int):
    """Rows (block, kind, id, ids, vec) sorted by block and kind: 0 indexed, 1 query."""

    def run(batches):
        at, forest, held_ids, held, named = None, None, [], [], []
        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(block)], strict=True):
                if a == b:
                    continue
                if block[a] != at:
                    at, forest, held_ids, held = block[a], None, [], []
                part = batch.slice(a, b - a)
                vec = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if kind[a] == 0:
                    held_ids.extend(part.column(3).to_pylist())
                    held.append(vec)
                    continue
                if not held:
                    continue
                if forest is None:
                    forest, named, held = Forest(np.concatenate(held), trees), held_ids, [True]
                n = len(forest.vectors)
                ids = part.column(2).to_pylist()
                for s in range(0, len(ids), 256):
                    out = [[], [], []]
                    found = forest.search(vec[s : s + 256], k + 1, max(least, int(share * n)))
                    for own, (c, cos) in zip(ids[s : s + 256], found, strict=True):
                        best = sorted((-x, v) for x, j in zip(cos.tolist(), c, strict=True) for v in named[j] if v != own)[:k]
                        for x, v in best:
                            for col, value in zip(out, (own, v, -x), strict=True):
                                col.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    trees: int = 32,
    candidate_share: float = 1.0,
    least_candidates: int = 400,
    block_rows: int = 4096,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine) of each query's k nearest
    vectors but its own id, nearest first, ties to the smaller id.

    Trees ascend until their ranges add up to candidate_share of the block's
    vectors (a vector counts once in each tree that offers it), least_candidates
    at the least.  Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, on either side; vectors meet those of
    their own dimension only.  Equal vectors are one entry that names its k + 1
    smallest ids, all that any query can need.  Repeated query rows are
    answered once.  Null ids take no part.  Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "ann")

    def usable(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
        finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return v.where(finite).where(F.exists("vec", lambda x: x != 0)).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))

    first = Window.partitionBy("vec").orderBy("id")
    some = usable(vectors).withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1)
    index = some.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("id", F.element_at("ids", 1))
    index = scratch.table(index.withColumn("dim", F.size("vec")), "vectors")
    asked = scratch.table(usable(queries).dropDuplicates(["id"]).withColumn("dim", F.size("vec")), "queries")
    # One row a dimension: no more than the longest vector has components.
    counts = F.broadcast(index.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
    place = index.join(counts, "dim").select(F.xxhash64("dim", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block"), F.lit(0).alias("kind"), "id", "ids", "vec")
    meet = asked.join(counts, "dim").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    meet = meet.select(F.xxhash64("dim", "b").alias("block"), F.lit(1).alias("kind"), "id", F.array("id").alias("ids"), "vec")
    found = (
        place.unionByName(meet)
        .repartition("block")
        .sortWithinPartitions("block", "kind", "id")
        .mapInArrow(_answers(k, trees, candidate_share, least_candidates), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
