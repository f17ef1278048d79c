"""Readers, writers and streams: broken input, leaves, versions, stops and states of jobs."""

import pytest
from pyspark.sql import functions as F

from docq.functions import geom
from docq.operators import agg
from docq.plans import jobs
from docq.sources import io
from docq.streaming import stream


def test_documents_of_many_lines_and_broken_ones(spark, tmp_path):
    for name, body in {"a.json": '{\n "a": 1\n}\n', "b.json": "\n", "f.json": "", "c.json": '{"a": 1', "sub/d.json": '{"a": null, "b": 2}', "e.json": "null"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    good, bad = io.read_docs(spark, str(tmp_path), "a int")
    assert sorted(map(tuple, good.collect()), key=str) == [(1, "a"), (None, "d")]
    assert sorted(r.doc_id for r in bad.collect()) == ["b", "c", "e"]


def test_review_sheet_counts_broken_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_text("\ufeffid, verdict,correct\n1,parser,\"a, b\"\n2,,\n3,model\n4,model,x,y\n", encoding="utf-8")
    good, bad = io.scan_review_csv(spark, str(tmp_path / "r.csv"))
    assert [tuple(r) for r in good.collect()] == [("1", "parser", "a, b")]
    assert sorted(r[0] for r in bad.collect()) == ["3,model", "4,model,x,y"] and bad.count() == 2


def test_field_texts_of_many_lines(spark, tmp_path):
    (tmp_path / "IMG1_Total.txt").write_text("\n1\n2 \n")
    assert [tuple(r) for r in io.read_field_texts(spark, str(tmp_path), ("Total",)).collect()] == [("IMG1", "Total", "1\n2")]


def test_leaves_have_one_file_or_parts_of_bounded_size(spark, tmp_path):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 20).cast("string"))).alias("split"), F.col("id").alias("v")).repartition(7)
    df = df.unionByName(spark.createDataFrame([(None, 1)], "split string, v long"))
    io.write_splits(df, "split", None, str(tmp_path / "o"), rows_per_file=200)
    files = {p.name: len(list(p.glob("part-*"))) for p in (tmp_path / "o").glob("split=*")}
    assert 8 <= files.pop("split=big") <= 16 and set(files.values()) == {1} and len(files) == 21
    assert max(len(p.read_text().splitlines()) for p in (tmp_path / "o/split=big").glob("part-*")) <= 200
    assert spark.read.json(str(tmp_path / "o")).count() == 2001
    io.write_splits(df.limit(0), "split", None, str(tmp_path / "none"))


def test_versions_are_claimed_once_and_the_first_is_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3)
    assert io.write_versioned(df, path).endswith("v=1")
    # Another writer has claimed the next number and is not there yet.
    (tmp_path / "t/_commits/2").write_text("")
    assert io.write_versioned(df.limit(2), path).endswith("v=3")
    assert io.write_versioned(df.limit(1), path).endswith("v=4")
    assert io.versions(spark, path) == [1, 3, 4]
    assert (io.read_current(spark, path).count(), io.read_backup(spark, path).count()) == (1, 3)
    assert io.drop_between(spark, path) == 1 and io.versions(spark, path) == [1, 4]


def test_profile_of_odd_columns(spark, tmp_path):
    df = spark.createDataFrame([(2, None, b"ab", [1]), (1, None, b"abc", [2]), (3, "x", None, None)], "k int, s string, b binary, a array<int>")
    got = {r.name: r for r in io.profile_table(df, ["k"]).collect()}
    assert [(n, r.type, r.rows, r.nulls, r.distinct, r["first"]) for n, r in got.items()] == [
        ("k", "int", 3, 0, 3, "1"), ("s", "string", 3, 2, 1, None), ("b", "binary", 3, 1, 2, "<bytes 3>"), ("a", "array<int>", 3, 1, 2, "[2]"),
    ]
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    assert {r.name: r["first"] for r in io.profile_files(spark, str(tmp_path / "p")).collect()}["k"] == "2"
    assert [r["rows"] for r in io.profile_table(df.limit(0)).collect()] == [0] * 4


def test_scores_stop_and_go_on(spark, tmp_path):
    import os

    gt = spark.createDataFrame([(1, "abcd")], "k int, gt string")
    (tmp_path / "in").mkdir()
    for step in (1, 2, 3):
        f = tmp_path / f"in/{step}.json"
        f.write_text(f'{{"k": 1, "step": {step}, "pred": "abc{step}"}}\n')
        os.utime(f, (1_700_000_000 + step, 1_700_000_000 + step))
    run = lambda until: stream.score_until(spark, str(tmp_path / "in"), "k int, step int, pred string", gt, "k", "step", str(tmp_path / "out"), str(tmp_path / "ck"), until)
    done = lambda: sorted(r.step for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert run(1) is True and done() == [1]
    assert run(2) is True and done() == [1, 2]
    assert run(None) is False and done() == [1, 2, 3]
    assert run(None) is False and done() == [1, 2, 3]


def test_labels_older_than_the_cutoff(spark, tmp_path):
    (tmp_path / "1.json").write_text("".join(f'{{"id": "{i}", "at": "2024-01-0{d}T00:00:00Z"}}\n' for i, d in (("a", 1), ("b", 5), ("c", 1), ("d", 1))))
    rows = stream.collect_labels(spark, str(tmp_path), "id string, at timestamp", "id", "at", None, "2024-01-03 00:00:00", ("c", "c"), ("d",))
    seen = []
    rows.writeStream.foreachBatch(lambda df, _: seen.extend(r.id for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == ["b", "c", "d"]


@pytest.mark.parametrize("events,want", [
    ([("processing", 0), ("failed", 404), ("completed", 0)], ("failed", 1, "404")),
    ([("failed", 429), ("processing", 0), ("completed", 0), ("failed", 500)], ("completed", 1, "429")),
    ([("failed", 500), ("failed", 503), ("failed", 429)], ("failed", 3, "500,503,429")),
    ([("failed", 599)], ("retry", 1, "599")),
    ([("failed", 600)], ("failed", 1, "600")),
])
def test_states_of_a_job(events, want):
    p = stream.JobStates(retries=2, backoff_ms=100)
    state = p._fold(("", 0, 0, ""), [(i * 10, i, s, c) for i, (s, c) in enumerate(events)])
    assert (state[0], *state[2:]) == want
    # In two parts it is the same.
    rows = [(i * 10, i, s, c) for i, (s, c) in enumerate(events)]
    assert p._fold(p._fold(("", 0, 0, ""), rows[:1]), rows[1:]) == state


def test_job_states_by_timers_and_out_of_order(spark, tmp_path):
    stream.state_store(spark)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "job string, id long, ts timestamp, status string, code int"

    def run(rows):
        spark.createDataFrame([(j, i, f"2024-01-01 {h}:00", s, c) for j, i, h, s, c in rows], "job string, id long, ts string, status string, code int").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        states = stream.job_states(spark.readStream.schema(schema).parquet(path), retries=1, backoff_ms=600_000, late="2 hours")
        states.writeStream.foreachBatch(stream.states_into(out)).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return {r.job: (r.status, r.attempts, r.failures) for r in stream.current_states(spark, out).collect()}

    got = run([("a", 1, "08:00", "failed", 429), ("b", 2, "08:01", "processing", 0), ("c", 3, "08:30", "failed", 500)])
    assert got == {"a": ("retry", 1, "429"), "b": ("processing", 0, ""), "c": ("retry", 1, "500")}
    # The watermark comes to 08:30: a's wait is over, c's is not; b's failure is late but not too late.
    got = run([("d", 4, "10:30", "pending", 0), ("b", 5, "08:00", "failed", 404)])
    assert got == {"a": ("pending", 1, "429"), "b": ("failed", 1, "404"), "c": ("retry", 1, "500"), "d": ("pending", 0, "")}
    got = run([("c", 6, "10:40", "failed", 500)])
    assert got["c"] == ("failed", 2, "500,500")


def test_words_hits_sizes_and_panels(spark):
    words = spark.createDataFrame([(1, 1, [0.0, 4.0], [1.0, 3.0], "b", 4.0), (1, 1, [5.0, -1.0], [2.0, 9.0], "a", 0.0)], "doc int, line int, x array<double>, y array<double>, w string, at double")
    assert tuple(geom.union_bbox(words, ["doc", "line"], "x", "y", "w", ["at"]).first()) == (1, 1, -1.0, 1.0, 5.0, 9.0, "a b")
    items = spark.createDataFrame([(1, "tea", "300", "s"), (1, "", None, "s"), (2, "cup", "5", "t")], "doc int, name string, price string, source string")
    got = agg.item_hits(items, spark.createDataFrame([(1, "tea 3,00")], "doc int, text string"), "doc", ["source"]).collect()
    assert sorted(map(tuple, got)) == [("s", 2, 1, 0), ("t", 1, 0, 0)]
    sizes = spark.createDataFrame([(i, 10 * i, 7) for i in range(1, 8)] + [(9, None, 7)], "id int, w int, h int")
    assert tuple(agg.size_profile(sizes, "id", "w", "h").first()) == (7, 10, 40, 70, 7, 7, 7, 0.0)
    s = spark.createDataFrame([(1, "x", "ab", "ab"), (1, "y", "ab", "ac"), (2, "x", "ab", "b"), (3, "z", "a", "a")], "id int, arm string, gt string, pred string")
    assert {r.id: (r.verdict, r.gain) for r in jobs.panel_index(s, "id", "arm", "x", "y").collect()} == {1: ("worse", -0.5), 2: ("missing", None)}


def test_tasks_write_named_files(spark, tmp_path, monkeypatch):
    """The driver's calls do not grow with the files."""
    calls, files = [], io._files
    monkeypatch.setattr(io, "_files", lambda *a: (calls.append(a), files(*a))[1])
    df = spark.range(40).select(F.concat(F.lit("é/"), (F.col("id") % 3).cast("string")).alias("folder"), F.concat(F.lit("a b%"), F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.when(F.col("id") > 0, F.lit("ü\nx")).alias("text"))
    io.named_files(df, str(tmp_path / "n"))
    io.named_files(df.limit(0), str(tmp_path / "none"))
    got = {str(p.relative_to(tmp_path / "n")): p.read_text(encoding="utf-8") for p in (tmp_path / "n").rglob("*") if p.is_file()}
    assert got == {f"é/{i % 3}/a b%{i}.txt": "ü\nx\n" if i else "\n" for i in range(40)}
    assert len(calls) == 2


def test_documents_of_src02_share_folders(spark, sf_dir, tmp_path, monkeypatch):
    from docq.plans import q_files

    monkeypatch.setattr(q_files, "folder", lambda *_: str(tmp_path / "d"))
    assert q_files.src02(spark, sf_dir).count() > 0
    assert len([p for p in (tmp_path / "d").iterdir() if p.is_dir()]) <= 5


def test_profile_counts_many_distinct_values_exactly(spark):
    df = spark.range(150_000).select("id", F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("z"), F.col("id").cast("string").cast("binary").alias("b"))
    assert {r.name: r.distinct for r in io.profile_table(df).collect()} == {"id": 150_000, "z": 1, "b": 150_000}


def test_means_at_a_threshold_do_not_hang_on_the_split(spark):
    """Of 0.1, 0.2 and 0.3 the sum is 0.6 or 0.6000000000000001, by the order."""
    df = spark.createDataFrame([(k, v) for k, o in enumerate([(0.1, 0.2, 0.3), (0.3, 0.2, 0.1)]) for v in o], "k int, v double").coalesce(1)
    assert {r.m for r in df.groupBy("k").agg(agg.steady_mean("v").alias("m")).collect()} == {0.6 / 3}
    odd = spark.createDataFrame([(1, float("inf")), (1, 1.0), (2, None)], "k int, v double")
    assert {r.k: r.m for r in odd.groupBy("k").agg(agg.steady_mean("v").alias("m")).collect()} == {1: float("inf"), 2: None}


def test_a_call_of_a_job_reads_and_writes_its_state_once():
    from types import SimpleNamespace

    calls, box = [], {}
    held = SimpleNamespace(get=lambda: (calls.append("get"), box.get("v"))[1], update=lambda v: (calls.append("update"), box.update(v=v)))
    handle = SimpleNamespace(getValueState=lambda *_: held, registerTimer=lambda t: calls.append(("set", t)), deleteTimer=lambda t: calls.append(("drop", t)))
    p = stream.JobStates(retries=2, backoff_ms=100)
    p.init(handle)
    event = lambda at, status, code=0: SimpleNamespace(at_ms=at, id=at, status=status, code=code)
    run = lambda now, *rows: [r.asDict() for r in p.handleInputRows(("j",), iter(rows), SimpleNamespace(getCurrentWatermarkInMs=lambda: now))]
    assert run(0, event(20, "failed", 500)) == [{"job": "j", "status": "retry", "at_ms": 20, "attempts": 1, "failures": "500"}]
    assert calls == ["get", ("set", 120), "update"]
    assert run(30, event(40, "failed", 429))[0]["failures"] == "500,429"
    assert calls[3:] == ["get", ("drop", 120), ("set", 240), "update"]
    # The first wait is seen from its own time on; an event before the others, within the watermark, comes first.
    assert run(30, event(35, "completed"))[0]["status"] == "completed"
    assert calls[7:] == ["get", ("drop", 240), "update"]


def test_tasks_move_the_files_of_leaves(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    asked, plain = [], DataFrameWriter.option
    monkeypatch.setattr(DataFrameWriter, "option", lambda self, k, v: (asked.append((k, v)), plain(self, k, v))[1])
    df = spark.range(1000).select(F.when(F.col("id") < 900, "big").otherwise("small").alias("leaf"), "id")
    io.write_leaves(df, ["leaf"], str(tmp_path / "t"), rows_per_file=100)
    assert ("mapreduce.fileoutputcommitter.algorithm.version", "2") in asked
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "t")).collect()) == list(range(1000))
    assert max(len(p.read_text().splitlines()) for p in (tmp_path / "t").rglob("*.json")) <= 100
