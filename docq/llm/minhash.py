"""Near-duplicate classes with HyperMinHash registers.

Each document's shingle set is reduced to `bands * rows` registers.  A shingle
falls into one bucket in each round; a bucket keeps the smallest value of the
first round that reached it, so sets smaller than the number of buckets fill
all of them too and registers of any two sets compare.  A register stores the
number of leading zeros of that value and a few mantissa bits (HyperMinHash).
Bands of registers propose links, the collision-corrected Jaccard estimate
drops hopeless ones, and full shingle sets confirm the rest.

Groups of copies never become all their pairs: equal sets are one class, a node;
within a band's bucket every class is first tested against the smallest one,
links are merged into components, and only classes of a bucket that are still in
different components are compared with each other, block by block.  In a bucket
of more than MANY_BLOCKS blocks they are first parted by the next band they
share.  A bucket, class or component that holds a large share of all rows is
joined by broadcasting its one row (scratch.skew_join), not by a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docq.llm.components import connected_components
from docq.llm.scratch import HOT_KEYS, HOT_ROWS, Scratch, bounded, skew_join
from docq.llm.words import NON_SPACE, U, mix, shingle_set, words_of

ROUNDS = 3
#: Rows of a bucket compared at once in one task.
BLOCK = 2048
#: Blocks of a bucket beyond which it is parted by a second band.
MANY_BLOCKS = 16
#: One class in so many is looked at to find the bands' buckets that hold very many.
SAMPLE = 32
#: The bits of a bucket's key that hold its band.
BAND_BITS = 127
_SEEDS = mix(np.arange(1, 4096, dtype=np.uint64) * U(0xD1342543DE82EF95))


def compress(values: np.ndarray, mantissa_bits: int) -> np.ndarray:
    """Leading zeros and the next mantissa bits of 64-bit values, as 16 bits."""
    v = np.maximum(values, U(1))
    top = np.frexp(v.astype(np.float64))[1].astype(np.int64)
    top = np.minimum(top, 64)
    zeros = (64 - top).astype(np.uint64)
    shifted = np.where(zeros >= U(63), U(0), v << np.minimum(zeros + U(1), U(63)))
    return ((zeros << U(mantissa_bits)) | (shifted >> U(64 - mantissa_bits))).astype(np.uint16)


def registers(sets: list[np.ndarray], size: int, mantissa_bits: int) -> np.ndarray:
    """One row of `size` registers for each non-empty set."""
    n = len(sets)
    lens = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), lens)
    empty_value = U(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * size, empty_value, dtype=np.uint64)
    for r in range(ROUNDS):
        x = mix(flat ^ _SEEDS[r])
        bucket = ((x >> U(32)) * U(size)) >> U(32)
        fresh = np.full(n * size, empty_value, dtype=np.uint64) if r else out
        np.minimum.at(fresh, owner * size + bucket.astype(np.int64), mix(x))
        if r:
            out = np.where(out == empty_value, fresh, out)
        left = (out.reshape(n, size) == empty_value).any(axis=1)
        if not left.all():
            keep = left[owner]
            flat, owner = flat[keep], owner[keep]
        if not len(flat):
            break
    out = out.reshape(n, size)
    for i in np.flatnonzero((out == empty_value).any(axis=1)):
        holes = np.flatnonzero(out[i] == empty_value)
        s = sets[i]
        best = np.full(len(holes), empty_value, dtype=np.uint64)
        for at in range(0, len(s), 1024):
            best = np.minimum(best, mix(s[at : at + 1024, None] ^ _SEEDS[None, ROUNDS + holes]).min(axis=0))
        out[i, holes] = best
    return compress(out, mantissa_bits)


def collision_rate(n_a: np.ndarray, n_b: np.ndarray, size: int, mantissa_bits: int) -> np.ndarray:
    """Chance that registers of two disjoint sets of these sizes are equal."""
    i = np.arange(64, dtype=np.float64)[None, :]

    def octave(n):
        load = np.maximum(np.asarray(n, dtype=np.float64)[:, None] / size, 1.0)
        upper, lower = np.exp2(-i), np.exp2(-i - 1)
        return np.exp(-load * lower) - np.exp(-load * upper)

    return (octave(n_a) * octave(n_b)).sum(axis=1) * 2.0**-mantissa_bits


def estimate(sig_a, sig_b, n_a, n_b, mantissa_bits: int) -> np.ndarray:
    """Jaccard similarity from equal registers, less chance collisions."""
    c = (sig_a == sig_b).mean(axis=1)
    p = collision_rate(n_a, n_b, sig_a.shape[1], mantissa_bits)
    return (c - p) / (1 - p)


def _sketch(k: int, size: int, mantissa_bits: int):
    def run(batches):
        for batch in batches:
            for w in words_of(batch.column(2), NON_SPACE):
                b = w.bounds()
                sets = [shingle_set(w.hashes[b[i] : b[i + 1]], k) for i in range(len(w.counts))]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = registers([sets[i] for i in full], size, mantissa_bits)
                sigs: list[bytes | None] = [None] * len(sets)
                for row, i in enumerate(full):
                    sigs[i] = sig[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(w.first, len(sets)),
                        batch.column(1).slice(w.first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_print(s) for s in sets], pa.binary()),
                        pa.array(sigs, pa.binary()),
                    ],
                    names=["id", "key", "n", "print", "sig"],
                )

    return run


def _print(s: np.ndarray) -> bytes | None:
    """What names a set; null for the empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sets(k: int):
    """(node, set) of rows (node, print, text) whose text has that print."""

    def run(batches):
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            for w in words_of(batch.column(2), NON_SPACE):
                b = w.bounds()
                sets = [shingle_set(w.hashes[b[i] : b[i + 1]], k) for i in range(len(w.counts))]
                keep = [i for i, s in enumerate(sets) if _print(s) == wanted[w.first + i]]
                off = np.concatenate(([0], np.cumsum([len(sets[i]) for i in keep]))).astype(np.int32)
                flat = np.concatenate([sets[i].view(np.int64) for i in keep]) if keep else np.zeros(0, np.int64)
                nodes = batch.column(0).take(pa.array([w.first + i for i in keep], pa.int64()))
                yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["id", "set"])

    return run


def _keys_of(sig: np.ndarray) -> np.ndarray:
    """Key of each band of signatures (n, bands, rows); its low bits are its band."""
    n, bands, rows = sig.shape
    weights = mix(np.arange(1, rows + 1, dtype=np.uint64))
    seeds = np.arange(1, bands + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
    key = mix((sig.astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64) + seeds)
    return (key & ~U(BAND_BITS)) | np.arange(bands, dtype=np.uint64)


def _signatures(column: pa.Array, bands: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), bands, -1)


def _band_keys(bands: int, hot: np.ndarray | None = None, inside: bool = False):
    """(key, id) for every band of the signature of rows (id, sig); of keys in the
    sorted array `hot` none, or with `inside` these alone."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = _keys_of(_signatures(batch.column(1), bands)).view(np.int64)
                for j in range(bands):
                    key, ids = keys[:, j], batch.column(0)
                    if hot is not None:
                        rows = np.flatnonzero(_member(key, hot)[1] == inside)
                        key, ids = key[rows], ids.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(key), ids], names=["key", "id"])

    return run


def _member(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in a sorted array, not empty, and whether it is there."""
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return at, among[at] == values


def _with_hubs(keys: np.ndarray, hubs: np.ndarray, held: np.ndarray):
    """(key, id, hub, held) of rows (key, id), all of whose keys are in the sorted `keys`."""

    def run(batches):
        for batch in batches:
            at, _ = _member(batch.column(0).to_numpy(), keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hubs[at]), pa.array(held[at])], names=["key", "id", "hub", "held"])

    return run


def _second_bands(bands: int):
    """(key, sub, run, id) of rows (key, id, sig) for every band after the key's own."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys_of(_signatures(batch.column(2), bands))
            own = batch.column(0).to_numpy()
            for j in range(1, bands):
                rows = np.flatnonzero((own & BAND_BITS) < j)
                both = mix(mix(own[rows].view(np.uint64)) ^ keys[rows, j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), j, np.int32)), pa.array(both.view(np.int64)), batch.column(1).take(pa.array(rows))],
                    names=["key", "sub", "run", "id"],
                )

    return run


def _hopeful(mantissa_bits: int, least: float):
    """Pairs (a, b, n_a, n_b, sig_a, sig_b) whose estimate is at least `least`."""

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(m, -1) for i in (4, 5))
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            est = estimate(a, b, n_a, n_b, mantissa_bits)
            keep = np.flatnonzero(est >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(est[keep])], names=["a", "b", "est"])

    return run


def _hopeful_pairs(rows, band: int, sub: int, bands: int, mantissa_bits: int, least: float, percent: int):
    """(x, y) of a bucket's rows (block, id, root, n, sig, ...) in different
    components and, where there are two, different blocks, whose sizes and
    estimate allow a link; each pair in the first band that it shares, and in
    the second one where the bucket is parted by that."""
    block, root, n = (np.array([r[c] for r in rows], dtype=np.int64) for c in (0, 2, 3))
    sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(len(rows), -1)
    two = block.min() != block.max()
    for x in range(len(rows)):
        other = (root != root[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        other[: x + 1] = False
        if two:
            other &= block != block[x]
        y = np.flatnonzero(other)
        if len(y):
            y = y[estimate(sig[[x]], sig[y], n[[x]], n[y], mantissa_bits) >= least]
        if len(y):
            same = (sig[y].reshape(len(y), bands, -1) == sig[x].reshape(1, bands, -1)).all(axis=2)
            good = same.argmax(axis=1) == band
            if sub >= 0:
                same[:, band] = False
                good &= same.argmax(axis=1) == sub
            for z in y[good]:
                yield x, int(z)


def _runs(work, columns: list[tuple[str, pa.DataType]]):
    """work(at, rows) for each run of rows (run, i, j, key, sub, ...), sorted by the first three; at is all five."""

    def run(batches):
        held, at, out = [], None, []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)], names=[c for c, _ in columns])

        for batch in batches:
            for a, i, j, key, sub, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or (a, i, j) != at[:3]:
                    if len(held) > 1:
                        out.extend(work(at, held))
                    held, at = [], (a, i, j, key, sub)
                held.append(row)
            yield batch_of(out)
            out = []
        if len(held) > 1:
            out.extend(work(at, held))
        yield batch_of(out)

    return run


RUN = "run bigint, i int, j int, key bigint, sub int, block int, id bigint, root bigint, n bigint, sig binary"
_RUN_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _open(bands: int, mantissa_bits: int, least: float, percent: int):
    """The rows (RUN) that have a hopeful partner in their run: no more than came in."""

    def work(at, rows):
        has = {z for pair in _hopeful_pairs(rows, at[3] & BAND_BITS, at[4], bands, mantissa_bits, least, percent) for z in pair}
        return [(*at, *rows[z]) for z in sorted(has)]

    return _runs(work, [(name, _RUN_TYPES[kind]) for name, kind in (c.split() for c in RUN.split(", "))])


def _linked(bands: int, mantissa_bits: int, least: float, percent: int):
    """Links (a, b) that full sets confirm between components of a run, as many as
    join its components: fewer than its rows.  Rows end with the set."""

    def work(at, rows):
        parent: dict[int, int] = {}

        def find(r):
            while r in parent:
                r = parent[r]
            return r

        out = []
        sets = {}
        for x, z in _hopeful_pairs(rows, at[3] & BAND_BITS, at[4], bands, mantissa_bits, least, percent):
            a, b = find(rows[x][2]), find(rows[z][2])
            if a == b:
                continue
            for k in (x, z):
                if k not in sets:
                    sets[k] = np.array(rows[k][5], dtype=np.int64)
            same = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
            if 100 * same >= percent * (len(sets[x]) + len(sets[z]) - same):
                parent[max(a, b)] = min(a, b)
                out.append((min(rows[x][1], rows[z][1]), max(rows[x][1], rows[z][1])))
        return out

    return _runs(work, [("a", pa.int64()), ("b", pa.int64())])


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    threshold: float = 0.8,
    bands: int = 60,
    rows: int = 7,
    mantissa_bits: int = 10,
    slack: float = 0.11,
) -> DataFrame:
    """Near-duplicate component of each document.

    A document's set is its distinct shingles of `shingle_words` words (runs of
    non-space bytes, A-Z lower-cased); with fewer words the whole sequence is
    its one shingle.  Documents with Jaccard similarity of at least `threshold`
    (whole percents) are linked.  Returns, for each row of docs: doc_id,
    n_shingles, component_id (smallest id reachable), kept (it is that one).

    Null, empty or wordless text: no shingles, linked with nothing, kept.  Null
    id: not linked, component null, kept.  Repeated rows and equal texts share
    a component.  Several texts under one id are several documents, each with
    its own links; column `key` (decontam.text_key) tells them apart, and column
    `cluster` their components, which may bear one name: a number for each
    component of two rows or more, null for other rows.  Other columns of docs
    are not read.  An empty table gives an empty result.

    At similarity `threshold` = 0.8 a link escapes all bands with chance
    (1 - 0.8**7)**60 = 7e-7, and all but one, which is too few in a bucket of
    more than MANY_BLOCKS blocks, with 1.2e-5; `slack` is over five standard
    errors of the estimate.  Seven rows a band keep texts that merely share a
    passage out of each other's buckets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    percent, size, least = round(threshold * 100), bands * rows, threshold - slack
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col), F.length(F.col(text_col))).alias("key"), F.col(text_col).alias("text"))
    every = scratch.table(text.mapInArrow(_sketch(shingle_words, size, mantissa_bits), "id long, key long, n long, print binary, sig binary"), "sketch")

    # Equal sets have equal signatures.
    usable = every.where("n > 0 and id is not null")
    classes = usable.groupBy("print").agg(F.min(F.struct("id", "key")).alias("r"), F.min("n").alias("n"), F.count("*").alias("held"), F.first("sig").alias("sig"))
    classes = scratch.table(classes.select("print", F.col("r.id").alias("rep"), F.col("r.key").alias("rep_key"), "n", "held", "sig", F.monotonically_increasing_id().alias("node")), "classes")
    reps = classes.select(F.col("node").alias("id"), "n", "sig")

    shared = scratch.table(_buckets(reps.select("id", "sig"), bands), "buckets")
    star = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    star = scratch.table(star, "star")
    side = {x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab"}
    sizes_fit = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    hubs = scratch.table(star.groupBy("a").agg(F.count("*").alias("held")).join(side["a"], "a"), "hubs")
    hopeful = skew_join(star.join(side["b"], "b"), hubs, "a", "held", few=0, hot_keys=10_000).where(sizes_fit).select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
    hopeful = scratch.table(hopeful.mapInArrow(_hopeful(mantissa_bits, least), "a long, b long, est double"), "hopeful")
    scratch.drop(star, hubs)

    def sets_of(ids: DataFrame) -> DataFrame:
        """id, set of the nodes named."""
        wanted = classes.select(F.col("node").alias("id"), "rep", "rep_key", "print").join(bounded(scratch.table(ids.distinct(), "ids")), "id", "left_semi")
        wanted = scratch.table(wanted.withColumnRenamed("id", "node"), "wanted")
        named = text.join(bounded(wanted), F.expr("id = rep and key = rep_key")).select("node", "print", "text")
        return scratch.table(named.mapInArrow(_sets(shingle_words), "id long, set array<long>").dropDuplicates(["id"]), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b), a written table, whose full shingle sets reach the threshold."""
        sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
        firsts = pairs.groupBy("a").agg(F.count("*").alias("held")).join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        firsts = scratch.table(firsts, "firsts")
        both = skew_join(pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b"), firsts, "a", "held", few=0, hot_keys=1000)
        same = F.size(F.array_intersect("set_a", "set_b"))
        found = both.select("a", "b", same.alias("same"), (F.size("set_a") + F.size("set_b") - same).alias("all")).where(f"100 * same >= {percent} * all")
        out = scratch.table(found.select("a", "b"), name)
        scratch.drop(sets, firsts)
        return out

    # One link for each class first: its best hub.  Most components are whole after it.
    best = hopeful.groupBy("b").agg(F.max_by("a", F.struct("est", F.negative("a").alias("first"))).alias("a")).select("a", "b")
    best = scratch.table(best, "best")
    found = [confirmed(best, "links")]
    links = found[0]
    roots = connected_components(links, scratch)

    def with_root(df: DataFrame, col: str, name: str) -> DataFrame:
        r = roots.select(F.col("node").alias(col), F.col("root").alias("r_"))
        return df.join(r, col, "left").withColumn(name, F.coalesce("r_", col)).drop("r_")

    # Then whatever of the stars still joins two components.
    rest = with_root(with_root(hopeful.select("a", "b"), "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
    rest = scratch.table(rest, "rest")
    if not rest.isEmpty():
        found.append(confirmed(rest, "links"))
        links = links.union(found[-1])
        roots = connected_components(links, scratch)
    scratch.drop(hopeful, best, rest)

    # Last, classes of a bucket in components that no link joins yet: those with a
    # hopeful partner get their full sets and are compared with each other.  Only
    # links leave a task, and no more than join its components.
    rooted = scratch.table(with_root(shared.where("held > 2").select("key", "id", "held"), "id", "root"), "rooted")
    split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
    split = scratch.table(split.select("key", "rows"), "split")
    unlinked = skew_join(rooted, split, "key", "rows", "left_semi").join(reps, "id")
    few = F.col("held") <= BLOCK * MANY_BLOCKS
    open_rows = _blocked(unlinked.where(few).withColumn("run", F.col("key")).withColumn("sub", F.lit(-1)))
    if not split.where(F.col("rows") > BLOCK * MANY_BLOCKS).isEmpty():
        large = scratch.table(unlinked.where(~few).select("key", "id", "sig"), "large")
        parted = scratch.table(large.mapInArrow(_second_bands(bands), "key long, sub int, run long, id long"), "parted")
        counts = scratch.table(parted.groupBy("run").agg(F.count("*").alias("held")).where("held > 1").withColumn("rows", F.col("held")), "runs")
        again = with_root(skew_join(parted, counts, "run", "rows"), "id", "root").join(reps, "id")
        open_rows = open_rows.unionByName(_blocked(again))
    how = (bands, mantissa_bits, least, percent)
    some = open_rows.repartition("run", "i", "j").sortWithinPartitions("run", "i", "j").mapInArrow(_open(*how), RUN)
    some = scratch.table(some, "open")
    if not some.isEmpty():
        sets = sets_of(some.select("id"))
        full = some.join(sets, "id").select(*some.columns, "set")
        joined = full.repartition("run", "i", "j").sortWithinPartitions("run", "i", "j").mapInArrow(_linked(*how), "a long, b long")
        found.append(scratch.table(joined.distinct(), "links"))
        links = links.union(found[-1])
        roots = connected_components(links, scratch)
    # A component is named by the smallest id among its classes.
    linked = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root").distinct()).join(classes.select("node", "rep"), "node")
    linked = scratch.table(linked, "linked")
    names = scratch.table(linked.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("rows")), "names")
    named = classes.select("node", "print", "rep", "held").join(skew_join(linked.select("node", "root"), names, "root", "rows").select("node", "root", "component"), "node", "left")
    named = scratch.table(named.where("held > 1 or component is not null").select("print", F.coalesce("component", "rep").alias("component"), F.coalesce("root", "node").alias("cluster"), "held"), "named")
    scratch.drop(*(t for t, _ in scratch.held if t is not every and t is not named))

    out = skew_join(usable.select("id", "key", "n", "print"), named, "print", "held", "left").select("id", "key", "n", F.coalesce("component", "id").alias("component_id"), "cluster")
    out = out.unionByName(every.where("n = 0 or id is null").select("id", "key", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("cluster")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "key", "cluster")


def _buckets(signatures: DataFrame, bands: int) -> DataFrame:
    """key, id, hub (the smallest id), held (ids) of all buckets of two ids or more.

    signatures: id, sig, a written table.  Buckets that a sample of the ids shows to
    hold very many, at most 2 * HOT_KEYS, are counted by partial sums and their hubs
    go to the tasks; all others, in one shuffle.  A bucket that the sample misses is merely shuffled.
    """
    kind = "key long, id long"
    n = signatures.count()
    hot = np.zeros(0, np.int64)
    if n > HOT_ROWS:
        sample = signatures.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(_band_keys(bands), kind)
        # Each of these keys has more than one in 2 * HOT_KEYS of the sampled rows: there are fewer of them.
        least = max(HOT_ROWS // SAMPLE, sample.count() // (2 * HOT_KEYS))
        hot = np.sort(np.array([r.key for r in sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > least).collect()], dtype=np.int64))
    cold = signatures.mapInArrow(_band_keys(bands, hot if len(hot) else None), kind)
    bucket = Window.partitionBy("key")
    out = cold.select("key", "id", F.min("id").over(bucket).alias("hub"), F.count("*").over(bucket).alias("held")).where("held > 1")
    if len(hot):
        some = signatures.mapInArrow(_band_keys(bands, hot, inside=True), kind)
        hubs = sorted(some.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("held")).collect())
        found = _with_hubs(*(np.array([h[i] for h in hubs], dtype=np.int64) for i in range(3)))
        out = out.unionByName(some.mapInArrow(found, "key long, id long, hub long, held long").where("held > 1"))
    return out


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows (run, held, key, sub, id, root, n, sig) as RUN: dealt into blocks of about
    BLOCK rows of a run, once for each block that their own meets."""
    return (
        rows.withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("run", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "sub", "block", "id", "root", "n", "sig")
    )
