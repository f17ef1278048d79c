"""Benchmark decontamination by a prefix-filtered set join.

A window is `window_words` consecutive words of an item (the whole item where
it has fewer).  Its set is its shingles; a document that contains the window
contains all of them, so by the prefix principle (prefix length = size -
required overlap + 1 = 1 at full containment) it must contain the rarest one.
Shingles are ordered by how many documents hold them, counted over the whole
corpus; documents join windows on that one token.  A candidate then has to fit
by length and position (the window's first word at the token's place less its
offset, inside the document) before its words are compared with the window's.

Windows, tokens and candidates are tables.  All that a task holds of the
benchmark is a bitmap of at most `FILTER_BITS` bits, by which it leaves out
document tokens that no window has; a larger benchmark makes it less selective,
never wrong.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docq.llm.scratch import Scratch, bounded, skew_join
from docq.llm.spans import merged
from docq.llm.words import ALNUM, U, shingles, words_of

#: Bits of the largest filter: 16 MB.
FILTER_BITS = 1 << 27
_BITS_A_TOKEN = 256
OCCURRENCES = "array<struct<token:bigint,pos:bigint,at:int,near:string>>"


def _windows(window_words: int, shingle_words: int):
    """(item, win, k, words, tokens) for each window of each item."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for w in words_of(batch.column(1), ALNUM):
                b = w.bounds()
                for i in range(len(w.counts)):
                    lo, hi = b[i], b[i + 1]
                    size = min(window_words, hi - lo)
                    if not size:
                        continue
                    k = min(shingle_words, size)
                    item = batch.column(0)[w.first + i].as_py()
                    tokens = shingles(w.hashes[lo:hi], k).view(np.int64)
                    words = [w.raw[s:e].tobytes() for s, e in zip(w.starts[lo:hi], w.ends[lo:hi], strict=True)]
                    for at in range(hi - lo - size + 1):
                        for col, v in zip(out, (item, b" ".join(words[at : at + size]).decode(), k, size, tokens[at : at + size - k + 1]), strict=True):
                            col.append(v)
            kinds = (batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["item", "win", "k", "words", "tokens"])

    return run


class TokenFilter:
    """A bitmap that holds two bits of each token of a table; tells which tokens may be among them."""

    def __init__(self, tokens: DataFrame, most_bits: int = FILTER_BITS):
        """tokens: a column token (long).  At most most_bits / 64 rows reach the driver."""
        bits = 1 << 20
        wanted = tokens.count() * _BITS_A_TOKEN
        while bits < min(wanted, most_bits):
            bits *= 2
        self.mask = U(bits - 1)
        places = [F.col("token"), F.shiftrightunsigned("token", 32)]
        place = tokens.select(F.explode(F.array(*[p.bitwiseAND(F.lit(bits - 1)) for p in places])).alias("p"))
        one = F.expr("shiftleft(1L, cast(p % 64 as int))")
        words = place.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(one).alias("v")).collect()
        held = np.zeros(bits // 64, dtype=np.int64)
        held[[r.w for r in words]] = [r.v for r in words]
        self.bits = held.view(np.uint64)

    def _has(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) == U(1)

    def may_hold(self, tokens: np.ndarray) -> np.ndarray:
        """Indices of the tokens that may be in the table."""
        some = np.flatnonzero(self._has(tokens & self.mask))
        return some[self._has((tokens[some] >> U(32)) & self.mask)]


def _found(hashes: np.ndarray, owner: np.ndarray, sizes: list[int], known: TokenFilter):
    """(k, token, position) of the shingles inside one text that the filter lets through."""
    for k in sizes:
        sh = shingles(hashes, k)
        if len(sh):
            pos = known.may_hold(sh)
            pos = pos[owner[pos] == owner[pos + k - 1]]
            yield k, sh[pos], pos


def _frequency(sizes: list[int], known: TokenFilter):
    """Documents that hold each token, summed over a batch."""

    def run(batches):
        for batch in batches:
            seen, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for w in words_of(batch.column(0), ALNUM):
                owner = np.repeat(np.arange(len(w.counts)), w.counts)
                for _, token, pos in _found(w.hashes, owner, sizes, known):
                    once = np.unique(np.stack((token, owner[pos].astype(np.uint64))), axis=1)[0]
                    t, n = np.unique(once, return_counts=True)
                    seen.append(t)
                    count.append(n)
            t, at = np.unique(np.concatenate(seen), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(count), minlength=len(t)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], names=["token", "n"])

    return run


def _occurrences(sizes: list[int], window_words: int, known: TokenFilter):
    """n_words and the occurrences of prefix tokens in each text: token, position, and
    the words near it, in which the token begins at place `at`."""
    kind = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int64()), ("at", pa.int32()), ("near", pa.string())]))

    @F.arrow_udf(f"n_words long, found {OCCURRENCES}")
    def run(texts: pa.Array) -> pa.Array:
        n_words, out = [], []
        for w in words_of(texts, ALNUM):
            b, n = w.bounds(), len(w.counts)
            owner = np.repeat(np.arange(n), w.counts)
            found: dict[int, list] = {}
            for _, tokens, places in _found(w.hashes, owner, sizes, known):
                for token, pos in zip(tokens.view(np.int64).tolist(), places.tolist(), strict=True):
                    doc = int(owner[pos])
                    lo, hi = max(b[doc], pos - window_words + 1), min(b[doc + 1], pos + window_words)
                    near = b" ".join([w.raw[s:e].tobytes() for s, e in zip(w.starts[lo:hi], w.ends[lo:hi], strict=True)]).decode()
                    found.setdefault(doc, []).append({"token": token, "pos": int(pos - b[doc]), "at": int(pos - lo), "near": near})
            n_words.append(w.counts)
            out += [found.get(i, []) for i in range(n)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(out, kind)], names=["n_words", "found"])

    return run


def text_key(docs: DataFrame, text_col: str = "text"):
    """What names a text among the rows of one id."""
    return F.xxhash64(F.col(text_col), F.length(F.col(text_col)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_words: int = 10, shingle_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, hits).  rows: doc_id, key (see text_key), n_words of each row of docs.
    hits: doc_id, key, spans, items of those with a hit, once for each id and key.

    See decontaminate for what a hit is and how odd rows are treated.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    item = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.where("item_id is not null").select("item_id", "text")
    windows = rows.mapInArrow(_windows(window_words, shingle_words), f"item {item}, win string, k int, words int, tokens array<bigint>").distinct()
    windows = scratch.table(windows, "windows")
    sizes = sorted(r.k for r in windows.select("k").distinct().collect())  # at most shingle_words of them
    text = docs.select(F.col(text_col).alias("text"))
    different = windows.dropDuplicates(["win"]).select("win", "words", F.posexplode("tokens").alias("offset", "token"))
    vocab = scratch.table(different.select("token").distinct(), "vocabulary")
    counts = text.mapInArrow(_frequency(sizes, TokenFilter(vocab)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = scratch.table(vocab.join(counts, "token"), "frequencies")
    # A window all of whose tokens occur is found by its rarest; the others cannot occur.
    ranked = different.join(bounded(counts), "token", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset", "words")).alias("r"))
    prefix = scratch.table(ranked.where("r.n > 0").select("win", "r.*"), "prefix")
    seen = _occurrences(sizes, window_words, TokenFilter(prefix.select("token").distinct()))(F.col(text_col))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(docs, text_col).alias("key"), seen.alias("s_")).select("doc_id", "key", "s_.*")
    read = scratch.table(read, "occurrences")
    at = read.where("size(found) > 0").select("doc_id", "key", F.explode("found").alias("o")).select("doc_id", "key", "o.*").distinct()
    candidates = skew_join(at, prefix, "token", "n")
    start = F.col("pos") - F.col("offset")
    same = F.slice(F.split("near", " "), F.greatest(F.col("at") - F.col("offset") + 1, F.lit(1)), F.col("words"))
    held = candidates.where((F.col("offset") <= F.col("at")) & (F.array_join(same, " ") == F.col("win")))
    held = scratch.table(held.select("doc_id", "key", start.alias("start"), (start + F.col("words")).alias("end"), "win"), "verified")
    spans = held.groupBy("doc_id", "key").agg(merged(F.collect_set(F.struct("start", "end"))).alias("spans"))
    # A passage of very many documents is one window: its items go to its rows, not its rows to one task.
    named = scratch.table(windows.select("win", "item").join(held.groupBy("win").agg(F.count("*").alias("rows")), "win"), "named")
    names = skew_join(held.select("doc_id", "key", "win").distinct(), named, "win", "rows").groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    names = names.select(F.col("doc_id").alias("d_"), F.col("key").alias("k_"), "items")
    hits = spans.join(names, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("key") == F.col("k_"))).drop("d_", "k_")
    return read.select("doc_id", "key", "n_words"), scratch.table(hits, "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_words: int = 10, shingle_words: int = 5) -> DataFrame:
    """Words of each document that lie inside an occurrence of a benchmark window.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
    characters.  Returns, for each row of docs: doc_id, n_words, spans (word
    ranges hit, disjoint, end exclusive), items (ids of items with a window
    that occurs, sorted; of the type that item_id has).

    Null or empty text has no words; items without words or without an id take
    no part; equal items are all listed; repeated rows of docs each give a row;
    null ids are kept.  Without items every document is clean.  Other columns
    are not read.
    """
    rows, hits = contaminated(docs, benchmark, id_col, text_col, window_words, shingle_words)
    hits = hits.select(F.col("doc_id").alias("d_"), F.col("key").alias("k_"), "spans", "items")
    item = hits.schema["items"].dataType.simpleString()
    out = rows.join(bounded(hits), F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("key") == F.col("k_")), "left")
    none = "cast(array() as array<struct<start:bigint,end:bigint>>)"
    return out.select("doc_id", "n_words", F.coalesce("spans", F.expr(none)).alias("spans"), F.coalesce("items", F.expr(f"cast(array() as {item})")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_words: int = 10, shingle_words: int = 5) -> DataFrame:
    """The rows of docs without a hit, as they are; see decontaminate."""
    _, hits = contaminated(docs, benchmark, id_col, text_col, window_words, shingle_words)
    hits = hits.select(F.col("doc_id").alias("d_"), F.col("key").alias("k_"))
    return docs.join(bounded(hits), docs[id_col].cast("long").eqNullSafe(hits["d_"]) & (text_key(docs, text_col) == hits["k_"]), "left_anti")
