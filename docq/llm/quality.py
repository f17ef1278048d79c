"""Quality scores from supervised subword embeddings.

A text is a bag of its words, pairs of neighbouring words and character n-grams
of words (with the white space beside them, so that beginnings and ends are told
apart).  Each is hashed into a bucket; a bucket has a learned vector.  The mean
of a document's vectors goes through a softmax over the two classes.  Vectors and
output are trained by stochastic gradient descent in numpy on a bounded sample
of labelled rows; scores are of whole texts.  A word that repeats its
predecessor also counts as one pair of its own, whichever word it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docq.llm.scratch import Scratch
from docq.llm.words import CHUNK, U, mix

SPACE = np.zeros(128, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = U(0x9E3779B97F4A7C15)
#: Bucket of a word that repeats its predecessor.
SAME_AGAIN = 77


@dataclass(frozen=True)
class Settings:
    """max_labelled and max_bytes bound the rows that are fitted on: the first in the
    order of their ids' hash, up to so many rows and bytes of text; a row of more than
    max_bytes / 64 is not among them.  Nothing else is sampled."""

    max_labelled: int = 8000
    max_bytes: int = 12 << 20
    bits: int = 17
    grams: tuple[int, ...] = (3, 4)
    dim: int = 8
    epochs: int = 5
    batch: int = 32
    rate: float = 4.0
    seed: int = 11


@dataclass
class Model:
    """vectors of the buckets (zero where no training row has the bucket), softmax weights and biases."""

    vectors: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 2)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(2))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with one space around each (white space as 32), and where each text begins."""
    joined = " " + " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = SPACE[np.minimum(points, 127)]
    return np.where(space, U(32), points.astype(np.uint64)), np.cumsum([1, *(len(t) + 1 for t in texts)])


def features(texts: list[str], bits: int, grams: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every feature, with repeats, a kind of feature at a time.  grams: lengths of 3 or more."""
    p, begin = code_points(texts)
    space = p == 32
    first = np.flatnonzero(~space[1:] & space[:-1]) + 1
    after = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    if not len(first):
        return
    # The text of each place; the space after a text is its own.
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(begin))
    owner = np.concatenate((owner[:1], owner))
    down = U(64 - bits)
    # Words: sums of scrambled code points by place in the word.
    n = after - first
    head = np.cumsum(n) - n
    inside = np.flatnonzero(~space)
    rel = (np.arange(len(inside)) - np.repeat(head, n)).astype(np.uint64)
    words = mix(np.add.reduceat(mix(p[inside] + rel * _STEP), head))
    at = owner[first]
    yield at, (words >> down).astype(np.int64)
    pair = at[1:] == at[:-1]
    yield at[1:][pair], (mix(words[:-1] * U(3) + words[1:] * U(5))[pair] >> down).astype(np.int64)
    same = at[1:][pair & (words[1:] == words[:-1])]
    yield same, np.full(len(same), SAME_AGAIN)
    gaps = np.cumsum(space, dtype=np.int32)
    for g in grams:
        if len(p) < g:
            continue
        h = np.full(len(p) - g + 1, U(g))
        for j in range(g):
            h += p[j : len(p) - g + 1 + j]
            h *= _STEP
            h ^= h >> U(29)
        # No space inside; one at the beginning or the end may be.
        within = gaps[g - 2 : len(p) - 1] - gaps[: len(h)] == 0
        ok = np.flatnonzero(within & ~(space[: len(h)] & space[g - 1 :]))
        yield owner[ok + 1], (h[ok] * _STEP >> down).astype(np.int64)


def pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first, texts): runs of texts of about CHUNK characters; a longer text is a run of its own."""
    held, first, size = [], 0, 0
    for i, t in enumerate(texts.to_pylist()):
        t = t or ""
        if held and size + len(t) > CHUNK:
            yield first, held
            held, first, size = [], i, 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def _bags(settings: Settings):
    """y, total, buckets, counts (as int32 bytes) of each training text."""

    def run(batches):
        for batch in batches:
            for first, texts in pieces(batch.column(0)):
                key = [np.zeros(0, np.int64), *((o.astype(np.int64) << settings.bits) + b for o, b in features(texts, settings.bits, settings.grams))]
                key, count = np.unique(np.concatenate(key), return_counts=True)
                o, b, c = key >> settings.bits, (key & ((1 << settings.bits) - 1)).astype("<i4"), count.astype("<i4")
                cut = np.searchsorted(o, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(first, len(texts)), batch.column(2).slice(first, len(texts)),
                        pa.array([b[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        pa.array([c[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    ],
                    names=["id", "y", "buckets", "counts"],
                )

    return run


def train(y: np.ndarray, bounds: np.ndarray, buckets: np.ndarray, counts: np.ndarray, settings: Settings) -> Model:
    """Stochastic gradient descent on the cross-entropy of the softmax; a text's
    entries are buckets[bounds[i]:bounds[i + 1]]."""
    rng = np.random.default_rng(settings.seed)
    # Only buckets of the training rows are held.
    place = np.zeros(1 << settings.bits, dtype=np.int32)
    place[buckets] = 1
    used = np.flatnonzero(place)
    place[used] = np.arange(len(used))
    col = place[buckets]
    share = counts.astype(np.float32)
    share /= np.repeat(np.add.reduceat(counts, bounds[:-1], dtype=np.int64).astype(np.float32), np.diff(bounds))
    e = rng.uniform(-1 / settings.dim, 1 / settings.dim, (len(used), settings.dim))
    w, b = np.zeros((settings.dim, 2)), np.zeros(2)
    w[:, 1] = rng.uniform(-0.5, 0.5, settings.dim)
    w[:, 0] = -w[:, 1]
    rounds = settings.epochs * -(-len(y) // settings.batch)
    step = 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), settings.batch):
            rows = order[s : s + settings.batch]
            n = bounds[rows + 1] - bounds[rows]
            head = np.cumsum(n) - n
            at = np.repeat(bounds[rows] - head, n) + np.arange(int(n.sum()))
            c, x = col[at], share[at]
            hidden = np.add.reduceat(e[c] * x[:, None], head)
            z = hidden @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            rate = settings.rate * (1 - step / rounds)
            back = np.repeat(p @ w.T, n, axis=0) * x[:, None]
            w -= rate / len(rows) * hidden.T @ p
            b -= rate / len(rows) * p.sum(axis=0)
            # A text's share is spread over very many buckets, so each moves by the whole rate.
            hit, inv = np.unique(c, return_inverse=True)
            for d in range(settings.dim):
                e[hit, d] -= rate * np.bincount(inv, weights=back[:, d])
            step += 1
    vectors = np.zeros((1 << settings.bits, settings.dim), np.float32)
    vectors[used] = e
    return Model(vectors, w, b)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled documents, bounded as Settings says: the same rows in every run.

    labels: doc_id, quality (1 or 0; null is unlabelled; of repeated ids the
    largest).  Of several rows of docs with one id one is fitted on, that of the
    smallest hash of its text; texts without words are not.  Without labelled texts, or with one class only, every
    score is that class's side (0.5 without any).
    """
    scratch = Scratch(docs.sparkSession, "quality")
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    y = scratch.table(y, "labels")
    n = y.count()
    # Half as many again as wanted, of which the first are taken.
    part = min(1.0, (1.5 * settings.max_labelled + 1000) / max(n, 1))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    chosen = y.where(place < int(part * (1 << 30))).orderBy(place, "id").limit(settings.max_labelled)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= settings.max_bytes // 64)
    # At most max_labelled ids: a proven bound.
    labelled = text.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("r"))
    rows = scratch.table(labelled.select("id", "r.text", "r.y"), "labelled")
    # At most max_labelled rows of two numbers: one task orders them.
    so_far = F.sum("size").over(Window.orderBy(place, "id").rowsBetween(Window.unboundedPreceding, 0))
    within = rows.select("id", F.octet_length("text").cast("long").alias("size")).withColumn("size", so_far).where(F.col("size") <= settings.max_bytes).select("id")
    got = rows.join(F.broadcast(within), "id").select("text", "id", "y").mapInArrow(_bags(settings), "id long, y int, buckets binary, counts binary").toArrow().sort_by("id")
    scratch.drop(rows, y)
    got = got.filter(pc.greater(pc.binary_length(got["buckets"]), 0))
    label = got["y"].to_numpy().astype(np.int64).clip(0, 1)
    if len(set(label.tolist())) < 2:
        side = 2.0 * (2 * int(label[0]) - 1) if len(label) else 0.0
        return Model(bias=np.array([-side, side]))
    bounds = np.append(0, np.cumsum(pc.binary_length(got["buckets"]).to_numpy() // 4))

    def flat(name: str) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_buffer(), dtype="<i4") for x in got[name]])

    return train(label, bounds, flat("buckets"), flat("counts"), settings)


def score_of(text: Column, model: Model, settings: Settings = Settings()) -> Column:
    """The softmax's share of class 1 (0 to 1) of a whole text, from the text alone;
    null and empty texts get the score of the mean of no vectors, which is zero."""
    # The output is linear in the mean: each bucket adds one number.
    gain = (model.vectors @ (model.weights[:, 1] - model.weights[:, 0])).astype(np.float64)
    bias = float(model.bias[1] - model.bias[0])

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for first, some in pieces(texts):
            n, total = np.zeros(len(some)), np.zeros(len(some))
            for o, b in features(some, settings.bits, settings.grams) if len(gain) > 1 else ():
                n += np.bincount(o, minlength=len(some))
                total += np.bincount(o, weights=gain[b], minlength=len(some))
            out[first : first + len(some)] = total / np.maximum(n, 1)
        return pa.array(1 / (1 + np.exp(-np.clip(out + bias, -50, 50))))

    return run(text)


def score(docs: DataFrame, model: Model, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row of docs.  Null ids are kept; repeated rows
    get equal scores; other columns are not read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), score_of(F.col(text_col), model, settings).alias("score"))
