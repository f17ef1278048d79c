"""Operators without SQL, and cases that the tables do not hold."""

import datetime
import difflib
import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docq.functions import geom, metric, num, prompts, text
from docq.operators import agg, joins, reshape, rules, sampling, setops, tables, win
from docq.plans import jobs
from docq.sources import io
from docq.streaming import stream


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[1] for v in values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ('<table border="1"><thead><tr><th>A</th><th rowspan="2">B</th></tr></thead></table>', '<table><tr><td>A</td><td rowspan="2">B</td></tr></table>'),
        ("```html\n<table>\n<tr><td>a<br>b</td></tr>\n</table>\n```", "<table><tr><td>a<br/>b</td></tr></table>"),
        ("&#x27;x&#x27; &amp; y", "'x' & y"),
        ("● text", "● text"),
        ('<td colspan="3" class="x" rowspan="2">', '<td rowspan="2" colspan="3">'),
        (None, ""),
    ],
)
def test_canon(spark, given, want):
    assert one(spark, text.canon(F.col("t")), t=("string", given)) == want


def test_canon_long_white_space(spark):
    """A long run of white space inside a text is passed over once, not once from each of its places."""
    start = time.time()
    assert one(spark, text.canon(F.col("t")), t=("string", "\x0b<td a>&lt;" + " " * 150_000 + "b\x0c")) == "<td>< b"
    assert time.time() - start < 10


def test_text(spark):
    assert one(spark, text.compare_key(F.col("t")), t=("string", "● te xt")) == "text"
    assert one(spark, text.norm_key(F.col("t")), t=("string", "㈜ＡＢＣ 12")) == "주abc12"
    assert one(spark, text.detect_language(F.col("t")), t=("string", "가나다 abc")) == "mix"
    assert one(spark, text.drop_unprintable(F.col("t")), t=("string", "a�\x01\n b")) == "a\n b"
    assert one(spark, text.strip_fence(F.col("t")), t=("string", "```md\nx\n```")) == "x"
    assert one(spark, text.safe_table(F.col("t")), t=("string", "<td>a & <b>b</b></td><script>x</script>")) == "<td>a &amp; &lt;b&gt;b&lt;/b&gt;</td>"
    assert one(spark, prompts.particle(F.col("t"), "은", "는"), t=("string", "합계")) == "합계는"
    assert one(spark, num.to_int(F.col("t")), t=("string", "84,600원")) == 84600
    assert one(spark, num.to_int(F.col("t")), t=("string", "none")) is None


def test_metrics(spark):
    two = {"a": ("string", "abcd"), "b": ("string", "abxd")}
    assert one(spark, metric.cer(F.col("a"), F.col("b")), **two) == 0.25
    assert one(spark, metric.cer_unbounded(F.col("a"), F.col("b")), a=("string", "ab"), b=("string", "abababab")) == 3.0
    assert one(spark, metric.cer(F.col("a"), F.col("b")), a=("string", None), b=("string", "")) == 0.0
    assert one(spark, metric.cer_opcode("a", "b"), **two) == 0.25
    assert one(spark, metric.value_score(F.col("a"), F.col("b")), a=("string", None), b=("string", None)) == 1.0
    assert one(spark, metric.value_score(F.col("a"), F.col("b")), a=("string", "1,000.00001"), b=("string", "1000")) == 1.0
    assert one(spark, metric.avg_score(F.col("a"), F.col("b")), a=("double", 0.5), b=("double", None)) == 0.5


def test_matched_chars():
    """The blocks of difflib, also where hashes find them; texts of 40,000 characters within seconds."""
    r = random.Random(3)
    for n in (0, 5, 30, 60) * 50:
        a, b = ("".join(r.choice("ab\U0001f600") for _ in range(r.randint(0, n))) for _ in "ab")
        want = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert agg.matched_chars(a, b) == agg.matched_chars(a, b, small=4) == want
    words = ["".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(60)]
    a, b = ("".join(sorted(r.choice(words) + str(r.randint(1, 50)) for _ in range(4000))) for _ in "ab")
    start = time.time()
    share = agg.matched_share.func(pd.Series([a, "", None]), pd.Series([b, "x", None]))
    assert 0 < share[0] < 1 and list(share[1:]) == [0.0, 0.0]
    assert time.time() - start < 20


TABLE = "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"


@pytest.mark.parametrize(
    ("ref", "hyp", "want"),
    [(TABLE, TABLE, 1.0), ("text", TABLE, None), (TABLE, "text", 0.0), (TABLE, TABLE.replace(">d<", ">x<"), 1 - 1 / 7), (TABLE, TABLE.replace("<tr><td>c</td><td>d</td></tr>", ""), 1 - 3 / 7), (TABLE, TABLE.replace("<td>a", '<td colspan="2">a'), 1 - 1 / 7)],
)
def test_teds(spark, ref, hyp, want):
    got = one(spark, tables.teds("a", "b"), a=("string", ref), b=("string", hyp))
    assert got == pytest.approx(want) if want is not None else got is None


SECTIONS = "<TABLE><thead><tr><th>a<tbody><tr><td>b <b>c</b><em>no</em>d</td></tr></tbody></TABLE>"


def test_table_trees(spark):
    labels = [label for label, _ in tables._table_tree(SECTIONS)]
    assert labels == [("td", 1, 1, "a"), ("tr", 1, 1, ""), ("thead", 1, 1, ""), ("td", 1, 1, "b cd"), ("tr", 1, 1, ""), ("tbody", 1, 1, ""), ("table", 1, 1, "")]
    assert [first for _, first in tables._table_tree(SECTIONS)] == [0, 0, 0, 3, 3, 3, 0]
    both = {"a": ("string", SECTIONS + TABLE), "b": ("string", SECTIONS.replace("<th>a", "<th>x"))}
    assert one(spark, tables.teds("a", "b"), **both) == pytest.approx(1 - 1 / 7)
    assert one(spark, tables.teds("a", "b", structure_only=True), **both) == 1.0
    assert one(spark, tables.teds("a", "b"), a=("string", TABLE[:-8]), b=("string", TABLE)) is None
    assert one(spark, tables.teds("a", "b"), a=("string", TABLE), b=("string", None)) == 0.0


def test_tree_distance_is_a_metric_on_small_trees():
    import itertools

    def tree(rows):
        return tables._table_tree("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>")

    trees = [tree(r) for r in ([], ["a"], ["ab"], ["ab", "c"], ["ab", "cd"], ["b"], ["", "x"])]
    for a, b, c in itertools.product(trees, repeat=3):
        assert tables.tree_distance(a, b) == tables.tree_distance(b, a) >= 0
        assert tables.tree_distance(a, c) <= tables.tree_distance(a, b) + tables.tree_distance(b, c) + 1e-9
        assert (tables.tree_distance(a, b) == 0) == (a == b)


def test_spans_of_cells():
    html = '<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr><tr><td colspan="2">d|e</td></tr></table>'
    assert tables.grid_of(html) == [(0, 0, "a", True), (0, 1, "b", True), (1, 0, "", False), (1, 1, "c", True), (2, 0, "d|e", True), (2, 1, "", False)]
    assert tables.grid_of(None) == tables.grid_of("no table") == []


def test_grid_of_tokens(spark):
    tokens = ["<thead>", "<tr>", "<td", ' colspan="2"', ">", "</td>", "</tr>", "</thead>", "<tr>", "<td", ' rowspan="3"', ">", "</td>", "</tr>"]
    want = [(0, 0, "h x", True, True), (0, 1, "", True, False), (1, 0, "a", False, True), (1, 1, "", False, True)]
    assert tables.token_grid(tokens, ["<b>h</b>  x", "a"]) == want
    assert tables.token_grid(tokens, [])[0] == (0, 0, "", True, True)
    df = spark.createDataFrame([(1, tokens, ["h x", "a"]), (2, None, None)], "doc int, s array<string>, c array<string>")
    assert sorted(tuple(r) for r in tables.grid_from_tokens(df, "doc", "s", "c").collect()) == [(1, *w) for w in want]


def test_values_at_an_index(spark):
    for values in ([], [None, 3], list(range(1000, 0, -1)), [7] * 50 + [1, 2, 9], [float(i % 97) for i in range(5000)]):
        df = spark.createDataFrame([(v,) for v in values], "v double" if values and isinstance(values[0], float) else "v int")
        rest = sorted(v for v in values if v is not None)
        shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.999, "e": 1.0}
        want = [rest[min(int(len(rest) * s), len(rest) - 1)] if rest else None for s in shares.values()]
        assert list(agg.at_index(df, "v", shares).first()) == want


def test_stratified_split_of_one_large_and_a_null_stratum(spark):
    rows = [(i, "hot") for i in range(3000)] + [(3000 + i, None) for i in range(10)] + [(5000, "one")]
    got = sampling.stratified_split(spark.createDataFrame(rows, "id int, s string"), "s", "id").collect()
    counts = {}
    for r in got:
        counts[r.s, r.split] = counts.get((r.s, r.split), 0) + 1
    assert counts == {("hot", "train"): 2400, ("hot", "val"): 300, ("hot", "test"): 300, (None, "train"): 8, (None, "val"): 1, (None, "test"): 1, ("one", "test"): 1}
    assert sorted(r.id for r in got) == [i for i, _ in rows]


def box_rows(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc int, idx int, x1 double, y1 double, x2 double, y2 double")


def test_matching_of_boxes(spark):
    gt = box_rows(spark, [(0, 0.0, 0.0, 10.0, 10.0), (1, 0.0, 0.0, 10.0, 9.0), (2, 50.0, 50.0, 60.0, 60.0)])
    pred = box_rows(spark, [(0, 0.0, 0.0, 10.0, 10.0), (1, 100.0, 100.0, 110.0, 110.0)])
    m = {r.a_idx: r for r in joins.iou_match(gt, pred, "doc", "idx").collect()}
    assert [m[i].matched for i in range(3)] == [True, False, False] and m[2].iou == 0.0
    assert [tuple(r)[1:] for r in sorted(joins.greedy_l1(gt, pred, "doc", "idx", 60).collect())] == [(0, 0)]
    pairs = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.9), (1, 1, 1, 0.9), (1, 1, 0, 0.1)], "doc int, a_idx int, b_idx int, s double")
    assert sorted((r.a_idx, r.b_idx) for r in joins.greedy_best(pairs, "doc", "s").collect()) == [(0, 0), (1, 1)]
    d = joins.reading_inversions(box_rows(spark, [(0, 0.0, 100.0, 10.0, 110.0), (1, 0.0, 0.0, 10.0, 10.0)]), "doc", "idx").first()
    assert d.inversions == 1


def test_lines_follow_their_first_box(spark):
    b = box_rows(spark, [(i, float(i), 6.0 * i, i + 1.0, 6.0 * i + 10) for i in range(4)])
    assert [r.line for r in sorted(win.line_group(b, "doc", "idx").collect())] == [0, 0, 1, 1]


def test_bbox(spark):
    assert one(spark, geom.as_bbox(F.col("t")), t=("string", "[1, 2, 3, 4]")) == [1.0, 2.0, 3.0, 4.0]
    assert one(spark, geom.as_bbox(F.col("t")), t=("string", "[1, 2]")) is None
    assert one(spark, geom.as_bbox(F.col("t")), t=("string", "x")) is None


def test_pages(spark):
    page = {"width": 1, "height": 2, "parsing_res_list": []}
    bodies = [json.dumps({"result": {"elements": [{"json": page}]}}), json.dumps(page), "{broken", json.dumps({"parsing_res_list": []}), None]
    pages, reasons = reshape.pages(spark.createDataFrame(list(enumerate(bodies)), "doc int, body string"), "doc", "body")
    assert sorted(r.doc for r in pages.collect()) == [0, 1]
    assert {r.doc: r.reason for r in reasons.collect()} == {2: "no_page_json", 3: "no_size", 4: "no_page_json"}
    # The JSON is read by one expression: neither the filter nor each column reads it again.
    plan = pages.select("doc", "width", "height")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2


@pytest.mark.parametrize(
    ("field", "value", "want"),
    [
        ("merchant_phone", "123-45-67890", ["business_no_in_phone"]), ("merchant_phone", "02-123-4567", []), ("total", "천원", ["money_without_digit", "money_with_hangul"]), ("total", " ", ["empty"]),
        ("merchant_name", "1", ["one_char", "name_without_letter"]), ("transaction_date", "today", ["date_without_digit"]),
    ],
)
def test_field_flags(spark, field, value, want):
    assert one(spark, rules.field_flags(F.col("f"), F.col("v")), f=("string", field), v=("string", value)) == want


def test_failures(spark):
    def kind(gt, pred):
        return one(spark, rules.failure_type(F.col("g"), F.col("p")), g=("string", gt), p=("string", pred))

    assert kind("abc", None) == "empty" and kind("abc", "abc") is None and kind("abc", "repeat this x" * 10) == "loop"
    assert kind("abc", r"\frac{a}{b}") == "latex" and kind("가나다라", "abcdefgh") == "language"
    assert kind("abc", "".join(chr(97 + (i * i) % 26) + str(i) for i in range(60))) == "runaway"


def test_consensus(spark):
    rows = [("x y", "xy", "x y"), ("● long text here", "○ long text here", "other"), ("p", "same", "same"), ("a", "b", "c")]
    got = jobs.consensus(spark.createDataFrame(rows, "p string, a string, b string"), "p", "a", "b").collect()
    assert [(r.grade, r.label, r.parser_changed) for r in got] == [("high", "x y", False), ("mid", "● long text here", False), ("mid", "same", True), ("low", "a", False)]


def test_review(spark):
    blocks = spark.createDataFrame([(1, 0, 5.0, 0.0, "a"), (1, 1, 9.0, 0.0, "b"), (1, 2, 1.0, 0.0, "c")], "doc int, idx int, y double, x double, text string")
    acts = spark.createDataFrame([(1, 0, "edit", "A", None, None), (1, 1, "remove", None, None, None), (1, 7, "keep", "new", 0.5, 0.0)], "doc int, idx int, action string, new_text string, new_y double, new_x double")
    got = sorted(setops.review_blocks(blocks, acts, "doc").collect(), key=lambda r: r.order)
    assert [(r.text, r.added) for r in got] == [("new", True), ("c", False), ("A", False)]


def test_readers_and_writers(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"t": "a b"}\n{"t": "c\u0085d"}\n', encoding="utf-8")
    assert [r.t for r in io.read_jsonl(spark, str(p), "t string").collect()] == ["a b", "c\u0085d"]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/x.json").write_text('{"a": 1}')
    (tmp_path / "docs/y.json").write_text("{broken")
    good, bad = io.read_docs(spark, str(tmp_path / "docs"), "a int")
    assert [tuple(r) for r in good.collect()] == [(1, "x")] and [r.doc_id for r in bad.collect()] == ["y"]
    (tmp_path / "arr.json").write_text('[{"a": 1}, {"a": 2}]')
    assert io.read_json_array(spark, str(tmp_path / "arr.json"), "a int").count() == 2
    (tmp_path / "r.csv").write_text("﻿id,verdict\n1,parser\n2,\n", encoding="utf-8")
    assert [tuple(r) for r in io.read_review_csv(spark, str(tmp_path / "r.csv")).collect()] == [("1", "parser")]
    (tmp_path / "f/train").mkdir(parents=True)
    (tmp_path / "f/train/IMG1_Total.txt").write_text("12\n")
    (tmp_path / "f/IMG2_Other.txt").write_text("x")
    assert [tuple(r) for r in io.read_field_texts(spark, str(tmp_path / "f"), ("Total",)).collect()] == [("IMG1", "Total", "12")]
    (tmp_path / "y").mkdir()
    (tmp_path / "y/d.txt").write_text("3 0.5 0.5 0.2 0.4\nbad line\n")
    assert [tuple(r) for r in io.read_yolo(spark, str(tmp_path / "y")).collect()] == [("d", 3, 0.4, 0.3, 0.6, 0.7)]
    (tmp_path / "reg.jsonl").write_text('{"_comment": "x"}\n{"dataset_name": "a"}\n')
    assert io.read_registry(spark, str(tmp_path / "reg.jsonl")).count() == 1
    assert {r.ext: r.files for r in io.inventory(spark, str(tmp_path / "f")).collect()} == {"txt": 2}
    df = spark.createDataFrame([(1, "a", "train", "m")], "id int, _x string, split string, meta string")
    io.write_samples(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).columns == ["id", "split"]
    io.write_splits(df, "split", None, str(tmp_path / "sp"))
    assert (tmp_path / "sp/split=train").is_dir()
    tree = spark.createDataFrame([("d", "s", "n", "t", 1)], "domain string, sub_domain string, dataset_name string, task_category string, v int")
    io.write_taxonomy_tree(tree, str(tmp_path / "tree"))
    assert (tmp_path / "tree/domain=d/sub_domain=s/dataset_name=n/task_category=t").is_dir()
    assert io.write_versioned(df, str(tmp_path / "v")).endswith("v=1") and io.write_versioned(df, str(tmp_path / "v")).endswith("v=2")
    io.write_ranked_csv(spark.createDataFrame([(1, 5.0, ["a", "b"])], "id int, s double, r array<string>"), str(tmp_path / "rank"), score="s", tie="id", reasons="r", n=5)
    assert spark.read.option("header", True).csv(str(tmp_path / "rank")).first().reasons == "a / b"
    m = io.package_manifest(df, "id", spark.createDataFrame([("x",), ("x",)], "reason string"), "reason").first()
    assert (m["count"], m.excluded) == (1, {"x": 2})


def test_streams(spark, tmp_path):
    schema, src = "id string, at timestamp, v int", tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"id": "a", "at": "2024-01-01T00:00:00Z", "v": 1}\n{"id": "b", "at": "2024-01-01T00:00:00Z", "v": 2}\n{"id": "a", "at": "2024-01-01T00:00:00Z", "v": 1}\n')
    out = str(tmp_path / "out")

    def run():
        s = stream.collect_labels(spark, str(src), schema, "id", "at")
        s.writeStream.foreachBatch(stream.latest_into(spark, out, "id", "at")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    run()
    (src / "2.json").write_text('{"id": "a", "at": "2024-01-01T00:05:00Z", "v": 9}\n')
    run()
    assert {r.id: r.v for r in stream.latest(spark, out, "id", "at").collect()} == {"a": 9, "b": 2}

    preds = tmp_path / "p"
    preds.mkdir()
    (preds / "1.json").write_text('{"k": 1, "model": "m", "pred": "abxd"}\n')
    gt = spark.createDataFrame([(1, "abcd")], "k int, gt string")
    for _ in range(2):  # the second run finds nothing new
        stream.score_on_arrival(spark, str(preds), "k int, model string, pred string", gt, "k", str(tmp_path / "scored"), str(tmp_path / "ck2")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "scored")).collect()] == [(1, "m", 0.25)]

    events = spark.createDataFrame([("j", "pending", 1), ("j", "completed", 3), ("j", "failed", 2)], "job string, status string, ts int")
    assert tuple(stream.job_status(events, "job", "status", "ts").first()) == ("j", "completed", 3, 1)


def test_upsert_and_collection(spark):
    log = spark.createDataFrame([("a", 1, None), ("b", 2, 2)], "k string, x int, y int")
    new, changes = setops.upsert(log, spark.createDataFrame([("b", 3, None), ("c", 4, 5)], "k string, x int, y int"), "k")
    assert sorted(map(tuple, new.collect())) == [("a", 1, None), ("b", 3, 2), ("c", 4, 5)]
    assert sorted((r.k, r.col, r.old, r.new) for r in changes.where("k = 'b'").collect()) == [("b", "x", "2", "3")]
    t = datetime.datetime(2024, 1, 1)
    files = spark.createDataFrame([("a", t), ("b", datetime.datetime(2024, 2, 1)), ("c", t)], "id string, at timestamp")
    got = setops.collect_since(files, files.where("id = 'b'"), "id", "at", t, include=spark.createDataFrame([("c",)], "id string"))
    assert sorted((r.id, r.state) for r in got.collect()) == [("b", "updated"), ("c", "new")]


def plain_compare(gt, html):
    """The figures of one table in plain Python. gt: (name, numbers) by row."""
    import difflib

    grid = {}
    for r, c, text, _ in tables.grid_of(html, True):
        grid.setdefault(r, {})[c] = text
    read = [g for _, g in sorted(grid.items()) if len(g) >= 2 and g.get(0, "").strip()]
    a, b = [n for n, _ in gt], [g[0] for g in read]
    pairs = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag in ("equal", "replace"):
            n = min(i2 - i1, j2 - j1)
            pairs += [(i1 + k, j1 + k) for k in range(n)]
            i1, j1 = i1 + n, j1 + n
        pairs += [(i, None) for i in range(i1, i2)] + [(None, j) for j in range(j1, j2)]

    def cer(x, y):
        ops = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        return sum(max(i2 - i1, j2 - j1) for t, i1, i2, j1, j2 in ops if t != "equal") / max(len(x), len(y), 1)

    both = [(i, j) for i, j in pairs if i is not None and j is not None]
    cells = [(a[i], c, x, read[j].get(c, "")) for i, j in both for c, x in enumerate(gt[i][1], 1) if x or read[j].get(c, "")]
    chars = sum(len(a[i]) for i, _ in both)
    return {
        "gt_rows": len(a), "pred_rows": len(b), "row_recall": round(len(both) / len(a), 4) if a else None,
        "missing_rows": [a[i] for i, j in pairs if j is None], "spurious_rows": [b[j] for i, j in pairs if i is None],
        "name_cer": pytest.approx(sum(cer(a[i], b[j]) * len(a[i]) for i, j in both) / chars, abs=6e-5) if chars else None,
        "name_error_count": sum(a[i] != b[j] for i, j in both), "name_errors": [(a[i], b[j]) for i, j in both if a[i] != b[j]], "numeric_cells": len(cells),
        "numeric_accuracy": pytest.approx(sum(x == y for *_, x, y in cells) / len(cells), abs=6e-5) if cells else None, "numeric_errors": [c for c in cells if c[2] != c[3]],
    }


def plain_row(r):
    return {k: [tuple(x) if isinstance(x, tuple) else x for x in v] if isinstance(v, list) else v for k, v in r.asDict().items() if k != "doc"}


def test_rows_of_tables_on_both_sides(spark):
    gt = {
        1: [("cash", ["1", "2"]), ("stock", ["3", "4"]), ("land", ["5", ""]), ("debt", ["7", "8"])],
        2: [("only here", ["1"])],
        4: [("a", ["1"]), ("a", ["2"]), ("b", ["3"])],
    }
    tr = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    html = {
        1: "<table>" + tr("", "now") + tr("제 3 기", "x") + tr("cash", "1", "2") + tr("stoek", "3", "9") + tr("debt", "7") + tr("more", "1") + tr("note") + "</table>",
        3: "<table>" + tr("spurious", "1") + "</table>",
        4: '<table><tr><td rowspan="2">a</td><td>1</td></tr><tr><td>2</td></tr>' + tr("c", "3") + tr("d", "4") + "</table>",
    }
    g = spark.createDataFrame([(d, i, n, v) for d, rows in gt.items() for i, (n, v) in enumerate(rows)], "doc int, row int, name string, numbers array<string>")
    cells = tables.cells(spark.createDataFrame(list(html.items()), "doc int, html string"), "doc", "html", repeat=True)
    rows, summary = jobs.table_compare(g, cells, "doc")
    got = {r.doc: plain_row(r) for r in summary.collect()}
    head = tr("제 3 기", "x")
    assert got == {d: plain_compare(gt.get(d, []), html.get(d, "").replace(head, "")) for d in (1, 2, 3, 4)}
    assert [(r.gt_row, r.pred_row, r.status) for r in rows.where("doc = 1").collect()] == [(0, 0, "equal"), (1, 1, "misread"), (2, None, "missing"), (3, 2, "equal"), (None, 3, "spurious")]


def test_table_compare_query_equals_plain(spark, sf_dir):
    from docq.plans import q_more

    gt, html = q_more.compared_tables(spark, sf_dir)
    want, page = {}, {r.doc: r.html for r in html.collect()}
    for r in gt.orderBy("doc", "row").collect():
        want.setdefault(r.doc, []).append((r.name, r.numbers))
    got = {r.doc: plain_row(r) for r in q_more.job23(spark, sf_dir).collect()}
    assert got == {d: plain_compare(rows, page.get(d)) for d, rows in want.items()}
    for k in ("missing_rows", "spurious_rows", "name_errors", "numeric_errors"):
        assert any(r[k] for r in got.values())


def plain_diff(a, b):
    """Changes of one document: rows as dicts in order of idx."""
    import re

    bare = lambda t: re.sub(r"\s+", "", re.sub(r"<[^>]+>", "", t))
    used, out = set(), []
    for x in a:
        near = [(sum(abs(x[c] - y[c]) for c in ("x1", "y1", "x2", "y2")), j) for j, y in enumerate(b) if j not in used]
        d, j = min(near, default=(99, None))
        if d >= 60:
            out.append((x["idx"], None, "only_a"))
            continue
        used.add(j)
        y = b[j]
        s, t = bare(x["content"]), bare(y["content"])
        kinds = ["filled" if not s else "emptied" if not t else "text_changed"] if s != t else []
        if x["score"] is not None and y["score"] is not None and abs(y["score"] - x["score"]) > 0.02:
            kinds.append("score_up" if y["score"] > x["score"] else "score_down")
        out += [(x["idx"], y["idx"], k) for k in kinds + (["order_changed"] if x["order"] != y["order"] else [])]
    return out + [(None, y["idx"], "only_b") for j, y in enumerate(b) if j not in used]


BLOCK = "doc int, idx int, x1 double, y1 double, x2 double, y2 double, label string, content string, order int, score double"


def runs_of(a, b):
    out = []
    for df in (a, b):
        by = {}
        for r in df.orderBy("doc", "idx").collect():
            by.setdefault(r.doc, []).append(r.asDict())
        out.append(by)
    return {d: plain_diff(out[0].get(d, []), out[1].get(d, [])) for d in set(out[0]) | set(out[1])}


def test_runs_are_matched_by_place(spark):
    at = lambda y: (0.0, float(y), 100.0, y + 20.0)
    a = spark.createDataFrame([
        (1, 0, *at(0), "text", "one", 1, 0.9), (1, 1, *at(100), "text", "", 2, 0.5), (1, 2, *at(200), "table", "<td>x</td>", 3, None), (1, 3, *at(300), "text", "same  text", None, 0.5), (1, 4, *at(900), "text", "gone", 5, 0.5),
        (2, 0, *at(0), "text", "alone", 1, 0.5)], BLOCK)
    b = spark.createDataFrame([
        (1, 0, *at(500), "text", "new", 0, 0.5), (1, 1, *at(3), "text", "ONE", 2, 0.95), (1, 2, *at(99), "text", "now", 2, 0.49), (1, 3, *at(201), "table", "<td> </td>", 3, 0.7), (1, 4, *at(300), "text", "same <b>text</b>", None, 0.3)], BLOCK)
    changes, summary = jobs.diff_runs(a, b, "doc", "idx")
    got = sorted((r.doc, r.a_idx, r.b_idx, r.change) for r in changes.where("doc = 1 AND a_idx IS NOT NULL AND b_idx IS NOT NULL").collect())
    assert got == [(1, 0, 1, "order_changed"), (1, 0, 1, "score_up"), (1, 0, 1, "text_changed"), (1, 1, 2, "filled"), (1, 2, 3, "emptied"), (1, 3, 4, "score_down")]
    assert sorted((r.change, r.a_idx, r.b_idx) for r in changes.where("a_idx IS NULL OR b_idx IS NULL").collect()) == [("only_a", 0, None), ("only_a", 4, None), ("only_b", None, 0)]
    assert {(r.doc, r.blocks_a, r.blocks_b, r.filled, r.only_a, r.only_b) for r in summary.collect()} == {(1, 5, 5, 1, 1, 1), (2, 1, 0, 0, 1, 0)}
    by = {(r.a_idx, r.change): r for r in changes.where("doc = 1").collect()}
    assert by[0, "score_up"].delta == 0.05 and by[1, "filled"].chars == 3 and (by[0, "text_changed"].a, by[0, "text_changed"].b) == ("one", "ONE")
    layout = spark.createDataFrame([(1, 0, 4.0, 0.0, 100.0, 20.0, 0.1), (1, 1, 0.0, 0.0, 100.0, 20.0, 0.2), (1, 2, 0.2, 0.0, 100.0, 20.0, 0.3), (1, 3, 4.2, 0.0, 100.0, 20.0, 0.4)], "doc int, idx int, x1 double, y1 double, x2 double, y2 double, score double")
    assert [r.score for r in jobs.block_scores(a.where("doc = 1").drop("score"), layout, "doc", "idx").orderBy("idx").collect()] == [0.4, None, None, None, None]


def test_diff_blocks_query_equals_plain(spark, sf_dir):
    from docq.plans import q_more

    a, b = q_more.two_runs(spark, sf_dir)
    want = runs_of(a, b)
    kinds = ("text_changed", "score_up", "score_down", "filled", "emptied", "order_changed", "only_a", "only_b")
    got = {r.doc: [r[k] for k in kinds] for r in q_more.job22_blocks(spark, sf_dir).collect()}
    assert got == {d: [sum(c[2] == k for c in rows) for k in kinds] for d, rows in want.items()}
    assert all(sum(c) for c in zip(*[v for v in got.values()], strict=True))


def test_upload_mix(spark):
    rows = "doc int, images array<string>, answer string"
    small = spark.createDataFrame([(i, [f"r/{i}.jpg"], "old") for i in range(20)], rows)
    large = spark.createDataFrame([(i, [f"d/{i}.jpg"], "doc") for i in range(100, 160)], rows)
    blocks = spark.createDataFrame([(i, 0, "table", "<table><tr><td colspan='2'>x</td></tr></table>", [0.0], 0) for i in range(15)], "doc int, pos int, label string, content string, bbox array<double>, order_key int")
    have = spark.createDataFrame([(f"r/{i}.jpg",) for i in range(19)] + [(f"d/{i}.jpg",) for i in range(100, 160)], "ref string")
    mix, shares, missing = jobs.upload_mix(small, large, blocks, have, "doc", repeat=3, n_large=30, val=16)
    got = mix.collect()
    val = {r.doc for r in got if r.split == "val"}
    train = [r.doc for r in got if r.split == "train"]
    assert sum(d < 20 for d in val) == 8 and sum(d >= 100 for d in val) == 8 and not val & set(train)
    assert sorted(d for d in train if d < 20) == sorted([d for d in range(20) if d not in val] * 3) and len(set(train)) == 12 + 30 and len(train) == 36 + 30
    assert all(r.regenerated == (r.doc < 15) and (r.answer == "old" if 15 <= r.doc < 20 else "<td" in r.answer if r.doc < 15 else r.answer == "doc") for r in got)
    assert {(r.split, r.source, r.n, round(r.share, 4)) for r in shares.collect()} == {("train", "small", 36, round(36 / 66, 4)), ("train", "large", 30, round(30 / 66, 4)), ("val", "small", 8, 0.5), ("val", "large", 8, 0.5)}
    assert [tuple(r) for r in missing.collect()] == [("r", 1)]


def test_labeled_numbers_beside_and_below_tables(spark):
    rows = {1: [["sum", *["x"] * 1500, "7"]], 2: [["s um 8"], ["sum"], ["sum", "9", "10"]], 3: [["x", "1"]], 4: [["sum", "n/a"]], 6: [["x", "2"]]}
    rows |= {7: [["1 2, 3"]]}
    c = spark.createDataFrame([(d, r, i, x) for d, t in rows.items() for r, cells in enumerate(t) for i, x in enumerate(cells)], "doc int, row int, col int, text string")
    lines = {1: "sum 99", 3: "a 4\ns u m: none\nthe sum of 10 is -1,200 won\nsum 5", 4: "sum\r\nsum 3", 5: "sum 6", 6: "no key 7"}
    texts = spark.createDataFrame(list(lines.items()), "doc int, text string")
    got = lambda *a: {r.doc: r.v for r in tables.find_labeled(c, "doc", ("sum",), "v", *a).collect()}
    assert got() == {1: 7, 2: 9} and got(texts) == {1: 7, 2: 9, 3: -1200, 4: 3, 5: 6}
    assert {r.doc: r.v for r in tables.find_labeled(c, "doc", ("12",), "v").collect()} == {7: 123}


def test_canon_keeps_fences_inside(spark):
    assert one(spark, text.canon(F.col("t")), t=("string", "a\n```py\nb\n```\nc")) == "a\n```py\nb\n```\nc"
    assert one(spark, text.canon(F.col("t")), t=("string", " ```HTML\nx & y\n``` \n")) == "x & y"
    assert one(spark, text.canon(F.col("t")), t=("string", "\n a\t")) == "a"


def test_matchers_with_null_documents(spark):
    pairs = spark.createDataFrame([(None, 0, 0, 0.9), (None, 0, 1, 0.8), (None, 1, 0, 0.7), (5, 0, 1, 0.6)], "doc long, a_idx int, b_idx int, score double")
    got = sorted(map(tuple, joins.greedy_best(pairs, "doc", "score").collect()), key=str)
    assert got == [(5, 0, 1, 0.6), (None, 0, 0, 0.9)]
    boxes = spark.createDataFrame([(None, 0, 0.0, 0.0, 9.0), (None, 1, 0.0, 50.0, 59.0), (1, 0, 0.0, 0.0, 9.0), (1, 1, 3.0, None, None)], "doc long, idx int, x1 double, y1 double, y2 double")
    lines = {(r.doc, r.idx): r.line for r in win.line_group(boxes, "doc", "idx").collect()}
    assert lines == {(None, 0): 0, (None, 1): 1, (1, 1): 0, (1, 0): 1}


def test_review_and_tree(spark):
    from docq.plans import jobs

    c = spark.createDataFrame([(i, f"img{i}_seal" if i == 9 else f"img{i}", g, False, "p", f"```\nl{i}\n```") for i, g in ((1, "high"), (2, "low"), (3, "low"), (4, "mid"), (5, "low"), (9, "high"))], "id int, image string, grade string, parser_changed boolean, parser string, label string")
    v = spark.createDataFrame([(3, "Parser ", None), (4, "other", ""), (5, "what", None)], "id int, verdict string, correct string")
    gt, blocked = jobs.apply_review(c, v, "id", ["_seal"])
    assert sorted((r.id, r.image, r.label, r.source) for r in gt.collect()) == [(1, "img1", "l1", "consensus"), (3, "img3", "p", "human")]
    assert sorted((r.id, r.reason) for r in blocked.collect()) == [(2, "waiting"), (4, "no_correction"), (5, "unknown_verdict")]
    rows = spark.createDataFrame([("a", "t1"), ("a", "t1"), ("a", "t2")], "package string, task string")
    tasks = spark.createDataFrame([("a", "t1", "d", "c"), ("a", "t2", "d", "e")], "package string, task string, dataset_name string, category string")
    assert sorted((r.path, r.sample_count) for r in jobs.taxonomy_tree(rows, tasks, "package", "task")[1].collect()) == [("a/d/c.json", 2), ("a/d/e.json", 1)]
    with pytest.raises(Exception, match="no category for task t2"):
        jobs.taxonomy_tree(rows, tasks.where("task = 't1'"), "package", "task")[1].collect()


def test_plain_tables_are_split_by_one_expression(monkeypatch):
    """The same rows and trees as the parser's; it is left to texts that are not plain."""
    plain = '<table border="1"><tr class="r">\n<TH Colspan="2">a > é</th ><td rowspan="2" rowspan="3"> b<br>c</td></tr>' * 2 + "</table>tail"
    odd = ["<td a=b>x", "<td>a&amp;b</td>", "<td><!-- <td> -->x", "<script><td>x</script><td>y", '<td>x</td a="<">', "<td>a < b", "<td", "<br/><td>x", '<td colspan="2"rowspan="2">x']

    def read(cls, html, *a):
        p = cls(*a)
        p.feed(html)
        p.close()
        return p.rows if cls is tables._Rows else (p.nodes, p.open)

    expected = [(read(tables._Rows, h), read(tables._Tree, h, False)) for h in [plain, *odd]]
    for h, (rows, (nodes, opened)) in zip([plain, *odd], expected, strict=True):
        assert tables.rows_of(h) == rows
        assert tables._table_tree(h)[: len(nodes)] == nodes and len(tables._table_tree(h)) == len(nodes) + len(opened)
    monkeypatch.setattr(tables.HTMLParser, "feed", lambda *_: 1 / 0)
    assert tables.rows_of(plain) == expected[0][0]


def test_trees_of_one_shape_are_compared_by_labels(monkeypatch):
    def tree(cells):
        return tables._table_tree("<table>" + "".join(f"<tr><td>{c}</td><td>1</td></tr>" for c in cells) + "</table>")

    a, b, c = tree("RNRA"), tree("QNQA"), tree("NRAR")
    assert tables.tree_distance(a, b) == tables._zhang_shasha(a, b) == 2
    assert tables.tree_distance(a, c) == tables._zhang_shasha(a, c)
    monkeypatch.setattr(tables, "_zhang_shasha", lambda *_: 1 / 0)
    assert tables.tree_distance(a, b) == 2


def test_equal_names_are_not_diffed(monkeypatch):
    import difflib

    import pandas as pd

    names, texts = pd.Series([["a", "a", "b"], [], None]), pd.Series(["abc", "", None])
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *_, **__: 1 / 0)
    assert [[(m["gt_row"], m["pred_row"]) for m in x] for x in tables.seq_align.func(names, names)] == [[(0, 0), (1, 1), (2, 2)], [], []]
    assert list(metric.cer_opcode.func(texts, texts)) == [0.0] * 3


def test_fields_meet_their_names_without_a_shuffle_by_key(spark, monkeypatch):
    docs = spark.createDataFrame([(1, {"a": "x", "b": "y", "c": " "}), (1, {"b": "z"}), (2, {"d": "w"}), (3, {"a": "v"})], "doc int, fields map<string,string>")
    alias = spark.createDataFrame([("a", "A"), ("a", "AA"), ("b", "A"), ("c", "C")], "key string, common string")
    for most, kind in ((reshape.ALIASES, True), (2, False)):
        monkeypatch.setattr(reshape, "ALIASES", most)
        out = reshape.unify_fields(docs, "doc", "fields", alias)
        assert {r.doc: r.fields for r in out.collect()} == {1: {"A": "z", "AA": "x"}, 3: {"A": "v", "AA": "v"}}
        assert ("BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString()) is kind


def test_lines_come_with_the_boxes_columns(spark):
    from docq.operators import win

    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 20.0, "a"), (1, 1, 9.0, 3.0, 23.0, "b"), (1, 2, 0.0, 50.0, 70.0, "c"), (1, 3, 0.0, None, None, "d")], "doc int, idx int, x1 double, y1 double, y2 double, word string")
    got = win.with_line(df, "doc", "idx")
    assert {(r.word, r.line) for r in got.collect()} == {("d", 0), ("a", 1), ("b", 1), ("c", 2)} and got.columns == [*df.columns, "line"]


def test_tables_of_one_structure_are_laid_out_once(spark):
    tables._held_layout.cache_clear()
    tokens = ["<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td>", "</td>", "</tr>", "<tr>", "<td>", "</td>", "</tr>"]
    for i in range(50):
        assert tables.token_grid(tokens, [f"<i>{i}</i>", None]) == [(0, 0, str(i), False, True), (0, 1, "", False, True), (1, 0, "", False, False), (1, 1, "", False, True)]
    assert tables._held_layout.cache_info().misses == 1
    assert tables.token_grid([], ["x"]) == tables.token_grid(["<td>", "</td>"], ["x"]) == []
