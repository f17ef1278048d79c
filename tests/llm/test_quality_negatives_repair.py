"""Quality, hard negatives and conversation repair, against plain versions of themselves."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docq.llm import conversation_repair, hard_negatives, quality
from docq.llm import queries as q

SF = "/root/testdata/sf0.01"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_quality_held_out(spark):
    got = q.op11_quality(spark, SF).collect()
    label = {r.doc_id: r.quality for r in rows(spark, "labels")}
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows(spark, "documents"))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted for r in held if label[r.doc_id]]) > 0.97
    assert np.mean([r.predicted for r in held if not label[r.doc_id]]) < 0.25


def plain_features(text, grams):
    """Features of a text by names, in the order of their kinds."""
    words = text.split()
    out = [("w", w) for w in words]
    out += [("p", a, b) for a, b in zip(words, words[1:])]
    out += [("again",) for a, b in zip(words, words[1:]) if a == b]
    for g in grams:
        for w in words:
            padded = f" {w} "
            out += [("g", padded[i : i + g]) for i in range(len(padded) - g + 1) if not (padded[i] == padded[i + g - 1] == " ")]
    return out


@pytest.mark.parametrize("text", ["one two two\tthree", "a", "ab é漢字 ab ab", "  x  yy\n\nzzz  ", "", " "])
def test_quality_features_by_names(text):
    """Equal names have equal buckets, and there are as many of each."""
    bits, grams = 40, (3, 4)
    held = ["before it", text, "", "x y"]
    got = [(o, b) for owner, bucket in quality.features(held, bits, grams) for o, b in zip(owner.tolist(), bucket.tolist())]
    for i, t in enumerate(held):
        mine, names = [b for o, b in got if o == i], plain_features(t, grams)
        assert len(mine) == len(names)
        counts, wanted = defaultdict(int), defaultdict(int)
        for b in mine:
            counts[b] += 1
        for n in names:
            wanted[n] += 1
        assert sorted(counts.values()) == sorted(wanted.values())


def test_quality_scores_are_softmax_of_mean_vectors(spark):
    settings = quality.Settings(bits=10, dim=3)
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=(1024, 3)).astype(np.float32), rng.normal(size=(3, 2)), rng.normal(size=2))
    texts = [None, "", "one two two", "word " * 3000, "é漢字 x", "one two two"]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)] + [(None, "one two two", 5, "x")], "doc_id long, text string, score int, y string")
    got = {r.doc_id: r.score for r in quality.score(docs, model, settings).collect()}
    for i, t in enumerate(texts):
        b = np.concatenate([np.zeros(0, np.int64), *(b for _, b in quality.features([t or ""], 10, settings.grams))])
        mean = model.vectors[b].astype(float).mean(axis=0) if len(b) else np.zeros(3)
        z = mean @ model.weights + model.bias
        assert got[i] == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-6)
    assert got[None] == got[2] == got[5]


def test_quality_fit_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert all(r.score > 0.9 for r in quality.score(docs, model).collect())
    assert quality.score(docs.limit(0), quality.fit(docs, labels.limit(0))).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_quality_training_rows_are_bounded(spark, monkeypatch):
    seen = {}

    def train(y, bounds, buckets, counts, settings):
        seen["rows"] = len(y)
        return quality.Model()

    monkeypatch.setattr(quality, "train", train)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(1000, "long " * 1000)], "doc_id long, text string"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    quality.fit(docs, labels, quality.Settings(max_labelled=100))
    assert seen["rows"] == 100
    quality.fit(docs, labels, quality.Settings(max_bytes=800))
    assert 80 <= seen["rows"] <= 110


def plain_negatives(data, is_anchor, dim_of=len):
    """data: id -> (label, vector)."""
    v = {i: (y, [int(Fraction(x) * 256 // 1) for x in e]) for i, (y, e) in data.items()}
    out = []
    for a in sorted(i for i in v if is_anchor(i)):
        same, other = [], []
        for i, (y, e) in v.items():
            if i != a and len(e) == len(v[a][1]):
                (same if y == v[a][0] else other).append((-sum(x * z for x, z in zip(e, v[a][1])), i))
        same.sort()
        other.sort()
        for s, p in same[:5]:
            good = [(t, i) for t, i in other if 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(good[:10], 1)]
    return sorted(out)


def mined(df, **named):
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **named).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


@pytest.mark.parametrize("kind", ["uniform", "clusters", "equal", "large"])
def test_negatives_equal_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    n = 1500 if kind != "large" else 120
    x = rng.normal(size=(n, 6))
    if kind == "clusters":
        x = x * 0.1 + np.eye(6)[rng.integers(0, 6, n)] * 3
    if kind == "equal":
        x[::3] = x[0]
        x[1::7] = 0
    if kind == "large":
        x = x * 10.0 ** rng.integers(-3, 6, (n, 1))
    data = {i: (int(rng.integers(0, 3)), x[i].tolist()) for i in range(n)}
    df = spark.createDataFrame([(i, y, e, "x", 1) for i, (y, e) in data.items()], "vec_id long, label int, embedding array<double>, id string, rank int").repartition(3)
    # Blocks of 100 rows, packs of 4: walks end at different places in each.
    assert mined(df, block_rows=100, pack=4) == plain_negatives(data, lambda i: i % 10 == 0)


def test_negatives_walks_end_early():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(4096, 8)) * 0.05 + np.eye(8)[rng.integers(0, 8, 4096)]))
    block = hard_negatives.Block(np.arange(4096), np.zeros(4096, np.int64), x)
    looked = []

    def ok(ids, labels):
        looked.append(len(ids))
        return np.ones(len(ids), bool)

    got = hard_negatives.walk(block, x[:1], [[(5, ok, None, None)]])[0][0]
    assert [i for _, i in got] == sorted(range(4096), key=lambda i: (-(x[i] @ x[0]), i))[:5]
    assert sum(looked) < 2048


def test_negatives_edges(spark):
    inf = float("inf")
    some = [
        (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5]), (2, 2, [0.5, 0.5]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 2, [1.0, None]), (6, 2, [inf, 1.0]), (7, 2, [float("nan"), 1.0]),
        (8, 2, []), (None, 2, [1.0, 1.0]), (9, 2, [1.0, 1.0, 1.0]), (10, 1, [0.0, 0.0]), (11, 1, [2.0, 0.0]), (11, 1, [9.0, 0.0]), (12, 3, [1e308, -1e308]), (13, 2, [5e-324, 0.7]),
    ]
    df = spark.createDataFrame([(i, y, v, "x") for i, y, v in some], "vec_id long, label int, embedding array<double>, block string")
    used = {0: some[0][1:], 1: some[1][1:], 2: some[2][1:], 9: some[11][1:], 10: some[12][1:], 11: some[13][1:], 12: some[15][1:], 13: some[16][1:]}
    assert mined(df) == plain_negatives(used, lambda i: i % 10 == 0)
    assert mined(df.limit(0)) == [] and mined(df.where("label is null")) == []


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        last = text.strip(" \t\n\v\f\r")[-1:]
        if not last:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(turns):
    """turns: (turn, role, text), damaged and in order; the cheapest edits by a search over all of them, cheapest first."""
    said = [(r, t) for _, r, t in turns]
    fault = faults(said)
    heap, done, best = [(0, "", 0, 0, ())], set(), None
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(said) and state in (0, 3):
            best = cost, audit, out
            break
        for role in ("user", "assistant"):
            if to := step.get((state, role[0])):
                heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, f"{role}:")))
        if i < len(said):
            role, text = said[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if fault[i] in ("", "truncated"):
                more = fault[i] == "truncated"
                if to := step.get((state, role[:1])):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if to := step.get((state, name[0])):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to, (*out, f"{name}:{text}")))
    known = sorted(t for t, _, _ in turns if t is not None)
    gaps = known[-1] - known[0] + 1 - len(set(known)) if known else 0
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
    return (gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), *best[:2], "\n".join(best[2]))


def damage(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    name = ":".join(" " if x is None else str(x) for x in (conv, turn))
    d = zlib.crc32(name.encode()) % 20
    if d == 0:
        return []
    text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
    return [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)


def order(row):
    return (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode())


def test_repair_query_equals_search(spark):
    held = defaultdict(list)
    for r in rows(spark, "conversations"):
        held[r.conv_id] += damage(*r)
    got = q.op13_conversation_repair(spark, SF).collect()
    assert len(got) == len(held)
    for r in got:
        *numbers, audit, text = plain_repair(sorted(held[r.conv_id], key=order))
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == [*numbers, audit]
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repair_of_odd_conversations_equals_search(spark):
    rng = random.Random(4)
    words = ["Yes.", "no", " ", "", "What?", "end! ", "ok.\n", "é漢", None]
    roles = ["user", "assistant", "system", "tool", "", "User", None, "assistant", "user", "sage", "ape"]
    made = []
    for conv in [*range(60), None, -5]:
        n = rng.choice([0, 1, 2, 3, 5, 9, 14]) if conv not in (7, None) else 300
        made += [(conv, rng.choice([None, *range(-2, 12)]), rng.choice(roles), rng.choice(words), 1, "x") for _ in range(n)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string, kind int, audit string").repartition(5)
    held = defaultdict(list)
    for conv, turn, role, text, *_ in made:
        held[conv].append((turn, " " if role is None else role, " " if text is None else text))
    got = conversation_repair.repair(df).collect()
    assert {r.conv_id for r in got} == set(held) and len(got) == len(held)
    for r in got:
        want = plain_repair(sorted(held[r.conv_id], key=order))
        mine = "\n".join(f"{t.role}:{t.text}" for t in r.repaired)
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, mine) == want
    assert conversation_repair.repair(df.limit(0)).count() == 0


def test_repair_of_a_conversation_of_which_nothing_is_left(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", True), (2, 0, "user", "a.", None)], "conv_id long, turn long, role string, text string, away boolean")
    got = {r.conv_id: r for r in conversation_repair.repair(df, gone=F.col("away")).collect()}
    assert tuple(got[1]) == (1, 0, 0, 0, 0, 0, 0, "", []) and got[2].audit == "KI"


def test_conversations_longer_than_a_batch(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BATCH_ROWS", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        test_repair_of_odd_conversations_equals_search(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
