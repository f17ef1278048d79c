"""Hard negatives by walks over lists that a cluster of anchors shares.

Candidates stand in blocks of bounded size; anchors are clustered by direction,
and clusters split into packs of bounded size.  A pack meets every block (the
stated anchors against all rows, in blocks).  There the block's candidates are
sorted once by the most that an anchor of the pack can score with them: the
candidate's norm times the cosine of its angle to the pack's centre less the
pack's own angle.  Every member walks that list until nothing that is left can
enter its answer, which is certified by the bound; so answers are exact.  One
walk finds positives; a second one, with the windows that their scores open,
negatives.  A block's answers are merged by anchor.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docq.llm.scratch import Scratch

#: Candidates that a walk looks at in one step.
STEP = 512
#: Bounds are widened by so much of the norms, beyond any error of their sums.
SLACK = 1e-9
LONG = (1 << 63) - 1
HELD = "block long, kind int, ids array<long>, labels array<long>, vec array<double>, top array<array<long>>"


def scaled(flat: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of whole vectors: doubles where every inner product of such numbers
    is exact, else Python's whole numbers."""
    x = flat.reshape(-1, dim)
    if dim * (float(np.abs(x).max(initial=0)) * scale + 1) ** 2 < 2**52:
        return np.floor(x * float(scale))

    def exact(v: float) -> int:
        a, b = v.as_integer_ratio()
        return scale * a // b

    return np.array([[exact(v) for v in row] for row in x.tolist()], dtype=object)


class Block:
    """Candidates of one dimension: ids, labels, whole-number vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        # Components as doubles for the bounds alone; scaled down where squares would overflow.
        self.unit, self.norm = _directions(self.x)

    def shared_list(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates by falling bound, and the bounds, for a pack; a member's score is at most
        its own norm times the bound (norms as logarithms where they are large)."""
        unit, _ = _directions(members)
        centre = unit.sum(axis=0)
        size = np.linalg.norm(centre)
        centre = centre / size if size > 0 else centre
        wide = np.arccos(np.clip(unit @ centre, -1, 1)).max(initial=0) if size > 0 else math.pi
        away = np.arccos(np.clip(self.unit @ centre, -1, 1))
        bound = self.norm * (np.cos(np.maximum(0.0, away - wide)) + SLACK)
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero stays zero) and norms as doubles (infinite where none can hold them)."""
    if x.dtype == object:
        most = [max((abs(v) for v in row), default=0) or 1 for row in x.tolist()]
        part = np.array([[v / m for v in row] for row, m in zip(x.tolist(), most, strict=True)], dtype=float).reshape(x.shape)
        top = np.array([float(m) if m < 1e300 else np.inf for m in most])
    else:
        part, top = x, np.ones(len(x))
    n = np.linalg.norm(part, axis=1)
    return part / np.where(n > 0, n, 1)[:, None], np.where(n > 0, n * top, 0.0)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, (rows of a, rows of b); what a long can't hold stands at its ends."""
    if a.dtype == object or b.dtype == object:
        whole = [m if m.dtype == object else m.astype(np.int64).astype(object) for m in (a, b)]
        return np.clip(whole[0] @ whole[1].T, -LONG - 1, LONG)
    return a @ b.T


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score descending, then id."""
    if len(score) > 4 * k and score.dtype != object:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        keep = np.arange(len(score))
    return np.array(sorted(keep.tolist(), key=lambda j: (-score[j], ids[j]))[:k], dtype=np.int64)


def walk(block: Block, members: np.ndarray, wants: list[list[tuple]]) -> list[list[tuple]]:
    """For each member, for each of its wants (k, ok(ids, labels), low, high): the k first
    (score, id) among allowed candidates with low <= score <= high (None: no bound)."""
    order, bound = block.shared_list(members)
    _, norm = _directions(members)
    out = [[(np.zeros(0), np.zeros(0, np.int64)) for _ in w] for w in wants]
    walking = np.array([i for i, w in enumerate(wants) if w], dtype=np.int64)
    for at in range(0, len(order), STEP):
        # What a member may still meet; where it can't enter any answer, its walk has ended.
        going = []
        for i in walking.tolist():
            most = norm[i] * bound[at] + 1 if bound[at] > 0 else norm[i] * bound[at] * (1 - 1e-6) + 1
            most = most if np.isnan(most) else max(most, -LONG - 1)
            if any((low is None or (low <= high and not most < low)) and (len(s) < k or not most < s[k - 1]) for (k, _, low, high), (s, _) in zip(wants[i], out[i], strict=True)):
                going.append(i)
        walking = np.array(going, dtype=np.int64)
        if not len(walking):
            break
        some = order[at : at + STEP]
        ids, labels = block.ids[some], block.labels[some]
        scores = _products(members[walking], block.x[some])
        for i, score in zip(walking.tolist(), scores, strict=True):
            for j, (k, ok, low, high) in enumerate(wants[i]):
                s, named = out[i][j]
                good = ok(ids, labels)
                if low is not None:
                    good &= (score >= low) & (score <= high)
                if len(s) == k:
                    good &= score >= s[-1]
                if not good.any():
                    continue
                s, named = np.concatenate((s.astype(score.dtype), score[good])), np.concatenate((named, ids[good]))
                best = _first(s, named, k)
                out[i][j] = s[best], named[best]
    return [[list(zip(s.tolist(), named.tolist(), strict=True)) for s, named in o] for o in out]


def _window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores n with low * positive <= 100 * n <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _answers(scale: int, positives: int, negatives: int, window: tuple[int, int]):
    """Rows as HELD says, sorted by block and kind: 0 a candidate, 1 a pack of anchors,
    with the (id, score) of their positives in `top` for the second walk (null in the first).
    anchor_id, positive_id (null in the first walk), id, score."""

    def run(batches):
        at, block, held = None, None, []
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for r in range(batch.num_rows):
                if blocks[r] != at:
                    at, block, held = blocks[r], None, []
                if kinds[r] == 0:
                    # Runs of candidates are taken as columns.
                    if r and kinds[r - 1] == 0 and blocks[r - 1] == at:
                        continue
                    end = r + 1
                    while end < batch.num_rows and kinds[end] == 0 and blocks[end] == at:
                        end += 1
                    part = batch.slice(r, end - r)
                    flat = part.column(4).flatten().to_numpy(zero_copy_only=False)
                    held.append((part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy(), scaled(flat, len(flat) // (end - r), scale)))
                    continue
                if not held:
                    continue
                if block is None:
                    x = [h[2] for h in held]
                    if any(a.dtype == object for a in x):
                        x = [a if a.dtype == object else a.astype(np.int64).astype(object) for a in x]
                    block = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate(x))
                ids, labels = batch.column(2)[r].as_py(), batch.column(3)[r].as_py()
                flat = np.asarray(batch.column(4)[r].values.to_numpy(zero_copy_only=False))
                members = scaled(flat, len(flat) // len(ids), scale)
                tops = batch.column(5)[r].as_py()
                out = [[], [], [], []]
                if tops is None:
                    wants = [[(positives, lambda v, y, i=i, own=own: (y == own) & (v != i), None, None)] for i, own in zip(ids, labels, strict=True)]
                    named = [[None]] * len(ids)
                else:
                    pairs = [list(zip(t[::2], t[1::2], strict=True)) for t in tops]
                    wants = [[(negatives, lambda v, y, own=own: y != own, *_window(s, *window)) for _, s in p] for p, own in zip(pairs, labels, strict=True)]
                    named = [[i for i, _ in p] for p in pairs]
                for own, who, found in zip(ids, named, walk(block, members, wants), strict=True):
                    for positive, answer in zip(who, found, strict=True):
                        for s, v in answer:
                            for col, value in zip(out, (own, positive, v, int(s)), strict=True):
                                col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "positive_id", "id", "score"])

    return run


FOUND = "anchor_id long, positive_id long, id long, score long"


def centres_of(sample: np.ndarray, clusters: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres (unit vectors) of a sample of unit vectors, by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:clusters]]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.where(size > 0, size, 1), centres)
    return centres


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: int = 256,
    block_rows: int = 32768,
    pack: int = 32,
    sample: int = 4096,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * x).  An anchor's positives are its
    first `positives` other rows of its label; each pair's negatives the first
    `negatives` rows of other labels whose score is from window[0] to window[1] per
    cent of the positive's; higher scores come first, ties by smaller id.  Pairs
    without negatives give no rows.

    Rows with a null id, label or vector, or a null or non-finite component, take no
    part; of several rows with one id the smallest (label, vector) does.  Empty vectors
    take no part, and rows meet those of their own dimension only.  Scores are exact
    for components of any size; those that a long can't hold stand at its ends, and
    order and windows go by that.  Other columns are not read; an empty table gives no rows.  Cluster centres are fitted on at most
    `sample` anchors of smallest hash, for each dimension; they decide how long walks are, not what they find.
    """
    scratch = Scratch(vectors.sparkSession, "negatives")
    v = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    ).where("id is not null and label is not null and size(vec) > 0")
    v = v.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    one = v.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r"), F.max("anchor").alias("anchor"))
    rows = scratch.table(one.select("id", "r.label", "r.vec", "anchor", F.size("r.vec").alias("dim")), "rows")
    # One row a dimension: no more than the longest vector has components.
    sizes = F.broadcast(rows.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
    anchors = rows.where("anchor").drop("anchor")
    packs = scratch.table(_packs(anchors, pack, sample), "packs")
    where = F.xxhash64("dim", "b")
    place = rows.join(sizes, "dim").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    none = F.lit(None).cast("array<array<long>>")
    place = place.select(where.alias("block"), F.lit(0).alias("kind"), F.array("id").alias("ids"), F.array("label").alias("labels"), "vec", none.alias("top"))

    def walked(some: DataFrame) -> DataFrame:
        meet = some.join(sizes, "dim").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        meet = meet.select(where.alias("block"), F.lit(1).alias("kind"), "ids", "labels", "vec", "top")
        held = place.unionByName(meet).repartition("block").sortWithinPartitions("block", "kind")
        return held.mapInArrow(_answers(scale, positives, negatives, window), FOUND)

    def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = scratch.table(ranked(walked(packs.withColumn("top", none)), ["anchor_id"], positives), "positives")
    top = first.groupBy("anchor_id").agg(F.flatten(F.sort_array(F.collect_list(F.array("rank", "id", "score")))).alias("t"))
    # rank, id, score, rank, id, score, ... to id, score, id, score, ...
    top = top.select("anchor_id", F.filter("t", lambda x, i: i % 3 != 0).alias("t"))
    member = packs.select("dim", "pack", F.explode("ids").alias("anchor_id")).join(top, "anchor_id", "left")
    member = member.groupBy("dim", "pack").agg(F.sort_array(F.collect_list(F.struct("anchor_id", F.coalesce("t", F.array().cast("array<long>")).alias("t")))).alias("m"))
    packs = packs.join(member, ["dim", "pack"]).withColumn("top", F.col("m.t"))
    negative = ranked(walked(packs), ["anchor_id", "positive_id"], negatives)
    positive = first.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negative.join(positive, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _packs(anchors: DataFrame, pack: int, sample: int) -> DataFrame:
    """dim, pack, ids, labels, vec (one after another, by id): anchors by cluster, at most about `pack` of them in a row."""
    fitted = {}
    # Half as many again as wanted, of which the first are taken.
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    counts = F.broadcast(anchors.groupBy("dim").agg(((1.5 * sample + 1000) / F.count("*") * (1 << 30)).alias("most")))
    few = anchors.select("dim", "id").join(counts, "dim").where(place < F.col("most"))
    part = few.withColumn("n", F.row_number().over(Window.partitionBy("dim").orderBy(place, "id"))).where(F.col("n") <= sample).select("dim", "id")
    for r in anchors.join(part, ["dim", "id"], "left_semi").orderBy("dim", "id").select("dim", "vec").toLocalIterator():
        fitted.setdefault(r.dim, []).append(r.vec)
    centres = {}
    for dim, vecs in fitted.items():
        x = np.array(vecs) / np.maximum(np.abs(vecs).max(axis=1, keepdims=True), 1e-300)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        centres[dim] = centres_of(x, -(-len(x) // pack)).astype(np.float32)

    @F.arrow_udf("int")
    def cluster(vec: pa.Array, dim: pa.Array) -> pa.Array:
        out = np.zeros(len(vec), dtype=np.int32)
        dims = dim.to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x = vec.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
            out[at] = (x @ centres[d].T).argmax(axis=1)
        return pa.array(out)

    named = anchors.withColumn("cluster", cluster("vec", "dim"))
    # One row a cluster.
    parts = F.broadcast(named.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / pack).alias("parts")))
    named = named.join(parts, ["dim", "cluster"]).withColumn("pack", F.xxhash64("cluster", F.pmod(F.xxhash64("id"), F.col("parts"))))
    g = named.groupBy("dim", "pack").agg(F.sort_array(F.collect_list(F.struct("id", "label", "vec"))).alias("m"))
    return g.select("dim", "pack", F.col("m.id").alias("ids"), F.col("m.label").alias("labels"), F.flatten("m.vec").alias("vec"))
