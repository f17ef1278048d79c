"""Toxicity scores from a counterfactually regularised linear classifier.

Features are the presence of byte n-grams inside words and of whole words,
hashed to 64 bits, over whole texts.  Features are ranked by association with
the label over the training rows, and a logistic regression is fitted to the
best of them.  For each training sentence with an identity term the term is
swapped for others of its group, and the squared change of the sentence's score
is added to the loss, so a mention of a group by itself moves no score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docq.llm.scratch import Scratch
from docq.llm.words import _LOWER, CHUNK, U, buffers, byte_class, hash_runs, mix, word_runs

LETTERS = byte_class(b for b in range(256) if 0x61 <= b <= 0x7A or b >= 0x80)
#: Terms that name a group, by kind; any may stand for another of its kind.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("woman", "man"),
    ("women", "men"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("american", "mexican", "chinese", "indian", "african", "european"),
    ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"),
    ("disabled", "blind", "deaf"),
    ("old", "young", "elderly"),
)
MASK = 0xFFFFF


@dataclass(frozen=True)
class Settings:
    """max_labelled bounds the rows that are fitted on; nothing else is sampled."""

    max_labelled: int = 20_000
    max_features: int = 4096
    gram: int = 5
    min_docs: int = 5
    swaps: int = 2
    l2: float = 1e-4
    counterfactual: float = 10.0
    steps: int = 500
    identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS


@dataclass
class Model:
    """weights of features (sorted hashes) and a bias."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def text_features(texts: pa.Array, gram: int):
    """(first text, number of texts, owner, hash) a piece at a time, with repeats."""
    offsets, raw = buffers(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        off = offsets[at : to + 1] - offsets[at]
        low = _LOWER[raw[offsets[at] : offsets[to]]]
        starts, ends = word_runs(low, off, LETTERS)
        lens = ends - starts
        words = hash_runs(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        # All n-grams of words long enough: their starts, word by word.
        long = np.flatnonzero(lens >= gram)
        count = lens[long] - gram + 1
        head = np.cumsum(count) - count
        pos = np.repeat(starts[long] - head, count) + np.arange(int(count.sum()))
        g = np.zeros(len(pos), dtype=np.uint64)
        for j in range(gram):
            g = (g << U(8)) | low[pos + j].astype(np.uint64)
        where = np.concatenate((starts, pos))
        owner = np.searchsorted(off, where, side="right") - 1
        yield at, to - at, owner, np.concatenate((words, mix(g + U(gram * 0x9E3779B97F4A7C15 % 2**64))))
        at = to


def _counts(gram: int):
    """(feature, n1, n0): documents of each label that hold a feature, summed over a batch."""

    def run(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            got, ones, docs = [], [], []
            for first, n, owner, h in text_features(batch.column(0), gram):
                order = np.lexsort((h, owner))
                o, f = owner[order], h[order]
                keep = np.ones(len(f), dtype=bool)
                keep[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
                f, y = f[keep], toxic[first : first + n][o[keep]]
                u, inv = np.unique(f, return_inverse=True)
                got.append(u)
                ones.append(np.bincount(inv, weights=y, minlength=len(u)))
                docs.append(np.bincount(inv, minlength=len(u)))
            if got:
                u, inv = np.unique(np.concatenate(got), return_inverse=True)
                n1 = np.bincount(inv, weights=np.concatenate(ones)).astype(np.int64)
                both = np.bincount(inv, weights=np.concatenate(docs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n1), pa.array(both - n1)], names=["feature", "n1", "n0"])

    return run


def _present(h: np.ndarray, owner: np.ndarray, features: np.ndarray, table: np.ndarray):
    """Index of each (text, feature) that is present, once."""
    maybe = np.flatnonzero(table[(h & U(MASK)).astype(np.int64)])
    if not len(maybe):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(features, h[maybe]), len(features) - 1)
    good = features[at] == h[maybe]
    key = np.unique(owner[maybe][good] * np.int64(len(features)) + at[good])
    return key // len(features), key % len(features)


def _table(features: np.ndarray) -> np.ndarray:
    t = np.zeros(MASK + 1, dtype=bool)
    t[(features & U(MASK)).astype(np.int64)] = True
    return t


def _vectors(texts: list[str], features, table, gram) -> list[np.ndarray]:
    out = [np.zeros(0, np.int64)] * len(texts)
    for first, n, owner, h in text_features(pa.array(texts, pa.string()), gram):
        o, f = _present(h, owner, features, table)
        for i in range(n):
            out[first + i] = f[o == i] if len(o) < 64 else f[np.searchsorted(o, i) : np.searchsorted(o, i, "right")]
    return out


def swapped(sentence: str, terms, swaps: int) -> list[str]:
    """The sentence with its identity terms replaced by others of their groups."""
    kind = {t: g for g in terms for t in g}
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, kind), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE) if kind else None
    if not kind or not pattern.search(sentence):
        return []

    def other(step):
        def put(m):
            g = kind[m[0].lower()]
            return g[(g.index(m[0].lower()) + step) % len(g)]

        return put

    made = [pattern.sub(other(s), sentence) for s in range(1, swaps + 1)]
    return [x for x in dict.fromkeys(made) if x != sentence]


def _training(features, settings: Settings):
    """(y, on, plus, minus): features of a text; of each swap, those it loses and gains."""
    table = _table(features)
    any_term = re.compile("|".join(re.escape(t) for g in settings.identity_terms for t in g) or "(?!)", re.IGNORECASE)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            on = _vectors(texts, features, table, settings.gram)
            plus, minus = [], []
            for t in texts:
                a, b = [], []
                if any_term.search(t):
                    for s in re.split(r"[.!?\n]+", t):
                        if others := swapped(s, settings.identity_terms, settings.swaps):
                            own, *rest = _vectors([s, *others], features, table, settings.gram)
                            for r in rest:
                                lost, won = np.setdiff1d(own, r), np.setdiff1d(r, own)
                                if len(lost) or len(won):
                                    a.append(lost.tolist())
                                    b.append(won.tolist())
                plus.append(a)
                minus.append(b)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([x.tolist() for x in on], kind), pa.array(plus, pa.list_(kind)), pa.array(minus, pa.list_(kind))],
                names=["y", "on", "plus", "minus"],
            )

    return run


def fit_weights(rows, width: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Logistic loss (classes weighted alike) + l2 + counterfactual penalty, by Adam."""
    y = np.array([r["y"] for r in rows], dtype=float)
    owner = np.repeat(np.arange(len(rows)), [len(r["on"]) for r in rows])
    col = np.array([c for r in rows for c in r["on"]], dtype=np.int64)
    deltas = [(p, m) for r in rows for p, m in zip(r["plus"], r["minus"], strict=True)]
    d_owner = np.repeat(np.arange(len(deltas)), [len(p) + len(m) for p, m in deltas])
    d_col = np.array([c for p, m in deltas for c in (*p, *m)], dtype=np.int64)
    d_sign = np.array([s for p, m in deltas for s in (*(1.0 for _ in p), *(-1.0 for _ in m))])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, settings.steps + 1):
        z = np.bincount(owner, weights=w[col], minlength=len(y)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * share
        g = np.bincount(col, weights=err[owner], minlength=width) + settings.l2 * w
        if len(deltas):
            change = np.bincount(d_owner, weights=d_sign * w[d_col], minlength=len(deltas))
            g = g + 2 * settings.counterfactual / len(deltas) * np.bincount(d_col, weights=d_sign * change[d_owner], minlength=width)
        g = np.append(g, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most settings.max_labelled of the labelled documents, those of
    smallest hash of their id: the same in every run.

    labels: doc_id, toxic (1 or 0; null is unlabelled; of repeated ids the
    largest).  Of several rows of docs with one id one is fitted on, that of the
    smallest hash of its text.  Without labelled texts, or with one class only, the model has no
    features and its bias is that class's side (0 without any).
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    y = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    y = scratch.table(y, "labels")
    n = y.count()
    # Half as many again as wanted, of which the first are taken.
    part = min(1.0, (1.5 * settings.max_labelled + 1000) / max(n, 1))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    chosen = y.where(place < int(part * (1 << 30))).orderBy(place, "id").limit(settings.max_labelled)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # At most max_labelled ids: a proven bound.
    labelled = text.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("r"))
    rows = scratch.table(labelled.select("r.text", "r.y"), "training")
    size = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        scratch.drop(rows, y)
        return Model(bias=4.0 if n1 else -4.0 if n0 else 0.0)
    counts = rows.mapInArrow(_counts(settings.gram), "feature long, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counts = scratch.table(counts.where(F.col("n1") + F.col("n0") >= settings.min_docs), "counts")
    # Log-likelihood ratio of the 2 x 2 table of feature and label; what chance
    # gives the best of so many features is not kept.
    def term(seen, of, part):
        return F.when(seen > 0, seen * F.log(seen / (of * part))).otherwise(0.0)

    part = (F.col("n1") + F.col("n0")) / (n1 + n0)
    cells = [(F.col("n1"), n1, part), (F.col("n0"), n0, part), (n1 - F.col("n1"), n1, 1 - part), (n0 - F.col("n0"), n0, 1 - part)]
    ratio = 2 * sum((term(*c) for c in cells), F.lit(0.0))
    least = 2 * np.log(max(counts.count(), 2))
    best = counts.select("feature", ratio.alias("ratio")).where(F.col("ratio") > float(least)).orderBy(F.desc("ratio"), "feature").limit(settings.max_features)
    features = np.sort(np.array([r.feature for r in best.collect()], dtype=np.int64).view(np.uint64))
    if not len(features):
        scratch.drop(rows, y, counts)
        return Model(bias=0.0)
    trained = rows.mapInArrow(_training(features, settings), "y int, on array<long>, plus array<array<long>>, minus array<array<long>>").collect()
    scratch.drop(rows, y, counts)
    # Rows come in any order; sorted, the fit is the same in every run.
    trained = sorted(trained, key=lambda r: (r.y, r.on, r.plus))
    w, b = fit_weights(trained, len(features), settings)
    return Model(features, w, b)


def score_of(text: Column, model: Model, settings: Settings = Settings()) -> Column:
    """The score (0 to 1) of a whole text, from the text alone; null and empty
    texts get the score of a text without features."""
    table = _table(model.features)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = np.full(len(texts), model.bias)
        if len(model.features):
            for first, n, owner, h in text_features(texts, settings.gram):
                o, f = _present(h, owner, model.features, table)
                out[first : first + n] += np.bincount(o, weights=model.weights[f], minlength=n)
        return pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50))))

    return run(text)


def score(docs: DataFrame, model: Model, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row of docs.  Null ids are kept; repeated rows
    get equal scores; other columns are not read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), score_of(F.col(text_col), model, settings).alias("score"))
