"""Prefix scans, greedy matching and lines of boxes, against plain versions of themselves."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docq.operators import joins, scan, win


@pytest.fixture(scope="module")
def keyed(spark):
    """A key with most rows, a null key, small keys; nulls in order and values; a column named as helpers are."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        key = rng.choice(["hot", "hot", "hot", None, "b", f"k{i % 50}"])
        rows.append((key, rng.choice([None, rng.randrange(200)]), i, rng.choice([None, float(rng.randrange(-50, 50))]), "x"))
    return spark.createDataFrame(rows, "key string, ts long, id long, v double, n string").repartition(5).cache()


def windowed(keyed, expr, frame=(Window.unboundedPreceding, 0)):
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(*frame)
    return {r.id: r.x for r in keyed.withColumn("x", expr(w)).collect()}


@pytest.mark.parametrize("chunk", [1, 7, 40, 500, 100_000])
def test_scans_equal_windows(spark, keyed, chunk):
    order = ["ts", "id"]
    got = {r.id: r.running for r in scan.running_total(keyed, "key", order, "v", chunk).collect()}
    assert got == windowed(keyed, lambda w: F.sum("v").over(w))
    got = {r.id: r.v_filled for r in scan.forward_fill(keyed, "key", order, "v", chunk).collect()}
    assert got == windowed(keyed, lambda w: F.last("v", ignorenulls=True).over(w))
    for k in (0, 5):
        got = {r.id: r.moving for r in scan.moving_average(keyed, "key", order, "v", k, chunk).collect()}
        want = windowed(keyed, lambda w: F.avg("v").over(w), (-k, 0))
        assert {i: None if x is None else round(x, 9) for i, x in got.items()} == {i: None if x is None else round(x, 9) for i, x in want.items()}
    indexed = scan.row_index(keyed, "key", order, chunk)
    assert indexed.columns == [*keyed.columns, "i_", "n_"]
    assert {r.id: r.i_ + 1 for r in indexed.collect()} == {r.id: r.x for r in keyed.withColumn("x", F.row_number().over(Window.partitionBy("key").orderBy(*order))).collect()}
    sizes = {r.key: r["count"] for r in keyed.groupBy("key").count().collect()}
    assert all(r.n_ == sizes[r.key] for r in indexed.collect())
    held = defaultdict(list)
    for r in sorted(keyed.collect(), key=lambda r: (r.ts is not None, r.ts or 0, r.id)):
        held[r.key].append(r.id)
    want = sorted({ids[len(ids) * i // 4] for ids in held.values() for i in (1, 2, 3)})
    assert sorted(r.id for r in scan.quantile_pick(keyed, "key", order, 3, chunk).collect()) == want


def test_chunks_are_bounded_and_alike_on_any_partitioning(spark, keyed):
    a = scan.chunked(keyed, "key", ["ts", "id"], 40).rows
    sizes = {(r.key, r.chunk_): r["count"] for r in a.groupBy("key", "chunk_").count().collect()}
    assert len(sizes) > 30 and max(sizes.values()) < 40 * 3
    b = scan.chunked(keyed.repartition(2), "key", ["ts", "id"], 40).rows
    assert {r.id: r.chunk_ for r in a.collect()} == {r.id: r.chunk_ for r in b.collect()}


def test_no_window_over_a_key_alone(spark, keyed):
    df = scan.moving_average(keyed, "key", ["ts", "id"], "v", 3, 40)
    plan = df._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "windowspecdefinition(" in x]
    assert windows and all("chunk_" in x.split("windowspecdefinition(")[1].split("ASC")[0] for x in windows)
    assert "Python" not in plan


def test_scans_of_empty_tables(spark, keyed):
    none = keyed.limit(0)
    assert scan.running_total(none, "key", ["ts"], "v").count() == scan.quantile_pick(none, "key", ["ts"], 2).count() == 0


def plain_greedy(pairs, key):
    used, out = set(), []
    for p in sorted(pairs, key=key):
        if (p[0], "a", p[1]) not in used and (p[0], "b", p[2]) not in used:
            used |= {(p[0], "a", p[1]), (p[0], "b", p[2])}
            out.append(p)
    return sorted(out, key=str)


@pytest.mark.parametrize("fold", [0, 30, 10_000])
def test_greedy_best_in_rounds_and_folds(spark, monkeypatch, fold):
    monkeypatch.setattr(joins, "FOLD_PAIRS", fold)
    rng = random.Random(fold)
    pairs = {(doc, a, b): (doc, a, b, rng.choice([None, rng.random(), 0.5])) for doc in (1, 2, 3, None) for a in range(9) for b in range(9) if rng.random() < (0.9 if doc == 1 else 0.3)}
    pairs |= {(4, i, j): (4, i, j, 1.0 - i / 20 - (j - i) / 50) for i in range(8) for j in (i, i + 1)}  # a chain: each pair waits for the one before
    df = spark.createDataFrame(list(pairs.values()), "doc long, a_idx int, b_idx int, score double")
    got = sorted(map(tuple, joins.greedy_best(df, "doc", "score").collect()), key=str)
    assert got == plain_greedy(pairs.values(), lambda p: (p[3] is None, -(p[3] or 0), -p[1], -p[2]))
    assert joins.greedy_best(df.limit(0), "doc", "score").count() == 0


@pytest.mark.parametrize("fold", [0, 10_000])
def test_greedy_l1_and_its_leftovers(spark, monkeypatch, fold):
    monkeypatch.setattr(joins, "FOLD_PAIRS", fold)
    rng = random.Random(2)

    def side():
        return [(doc, i, *[rng.choice([rng.randrange(-40, 400) / 2, rng.randrange(0, 30)]) for _ in range(4)]) for doc in (1, None) for i in range(25)]

    a, b = side(), side()
    pairs = [(p[0], p[1], q[1], sum(abs(x - y) for x, y in zip(p[2:], q[2:]))) for p in a for q in b if p[0] == q[0]]
    want = [p[:3] for p in plain_greedy([p for p in pairs if p[3] < 60], lambda p: (p[1], p[3], p[2]))]
    assert len(want) > 5
    frames = [spark.createDataFrame([(d, i, *map(float, x)) for d, i, *x in rows], "doc long, idx int, x1 double, y1 double, x2 double, y2 double") for rows in (a, b)]
    assert sorted(map(tuple, joins.greedy_l1(*frames, "doc", "idx", 60).collect()), key=str) == sorted(want, key=str)
    outer = [tuple(r) for r in joins.greedy_l1_outer(*frames, "doc", "idx", 60).collect()]
    assert sorted((d, i) for d, i, j in outer if i is not None and d == 1) == [(1, i) for i in range(25)]
    assert sorted((d, j) for d, i, j in outer if j is not None and d == 1) == [(1, i) for i in range(25)]
    assert len([x for x in outer if None not in x[1:]]) == len(want)


def test_line_group_on_pages_of_any_size(spark):
    rng = random.Random(3)
    rows = [(doc, i, float(rng.randrange(50)), None if rng.random() < 0.05 else float(rng.randrange(0, 300)), rng.randrange(5, 40)) for doc, n in ((1, 400), (2, 3), (None, 30), (4, 1)) for i in range(n)]
    df = spark.createDataFrame([(d, i, x, y, None if y is None else y + h) for d, i, x, y, h in rows], "doc long, idx int, x1 double, y1 double, y2 double").repartition(4)
    got = {(r.doc, r.idx): r.line for r in win.line_group(df, "doc", "idx").collect()}
    want = {}
    for doc in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == doc), key=lambda r: (r[3] is not None, r[3] or 0, r[2], r[1]))
        heights = sorted(r[4] for r in mine if r[3] is not None)
        half = len(heights) // 2
        median = 0 if not heights else heights[half] if len(heights) % 2 else (heights[half - 1] + heights[half]) / 2
        line, top = -1, None
        for r in mine:
            if top is None or r[3] is None or abs(r[3] - top) > max(8.0, 0.6 * median):
                line, top = line + 1, r[3]
            want[doc, r[1]] = line
    assert got == want
    assert "Python" not in win.line_group(df, "doc", "idx")._jdf.queryExecution().executedPlan().toString()


def test_matched_boxes_of_small_large_and_null_documents(spark, monkeypatch):
    """Leftovers of a null doc are listed once; small documents take no join."""
    rng = random.Random(5)
    sizes = ((1, 4, 3), (2, 9, 9), (None, 5, 5), (3, 0, 2), (4, 2, 0), (5, 60, 0))
    kind = "doc long, idx int, x1 double, y1 double, x2 double, y2 double"
    a, b = ([(doc, i, *[float(rng.randrange(40)) for _ in range(4)]) for doc, *n in sizes for i in range(n[side])] for side in (0, 1))
    pairs = [(p[0], p[1], q[1], sum(abs(x - y) for x, y in zip(p[2:], q[2:], strict=True))) for p in a for q in b if p[0] == q[0]]
    want = [p[:3] for p in plain_greedy([p for p in pairs if p[3] < 50], lambda p: (p[1], p[3], p[2]))]
    want += [(p[0], p[1], None) for p in a if (p[0], p[1]) not in {w[:2] for w in want}] + [(q[0], None, q[1]) for q in b if (q[0], q[1]) not in {(w[0], w[2]) for w in want}]
    frames = [spark.createDataFrame(rows, kind) for rows in (a, b)]
    for fold in (2000, 50):
        monkeypatch.setattr(joins, "FOLD_PAIRS", fold)
        out = joins.greedy_l1_outer(*frames, "doc", "idx", 50)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
        assert fold < 2000 or "Join" not in out._jdf.queryExecution().executedPlan().toString()
