"""The whole pipeline on a small table, against a plain version of every stage."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from docq.llm import secret_scan, toxicity
from tests.llm.test_edges import brute_components, by_sets

SF = "/root/testdata/sf0.001"
SECRETS = {
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""": lambda m: len(m[1]) >= 6,
    r"AKIA[A-Z0-9]+": lambda m: len(m[0]) >= 20,
    r"[0-9a-f]+": lambda m: len(m[0]) >= 24,
} | {r.pattern: lambda m: True for r in secret_scan.EXTRA}


def windows(text, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return w, {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def contaminated(text, items):
    w, _ = windows(text)
    return any(tuple(w[i : i + len(x)]) == x for x in items for i in range(len(w) - len(x) + 1))


def redact(text):
    spans = sorted((m.start(), m.end()) for p, ok in SECRETS.items() for m in re.finditer(p, text) if ok(m))
    merged = []
    for a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in reversed(merged):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def plain(docs, labels, benchmark, model):
    """(doc_id, source, text) of the rows that reach packing."""
    weights = dict(zip(model.features.tolist(), model.weights, strict=True))
    rows = [r for r in docs if by_sets(r.text or "", weights, model.bias) < corpus_pipeline.TOXIC]
    stages = [len(rows)]
    # Rows in no component stay; of the others the first of each component in order of id.
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0))
    root = brute_components([r.text or "" for r in rows], 5, 80)
    rows = [r for i, r in enumerate(rows) if root[i] == i or r.doc_id is None or not (r.text or "").strip()]
    stages.append(len(rows))
    items = set().union(*(windows(b.text)[1] for b in benchmark))
    rows = [r for r in rows if not contaminated(r.text, items)]
    stages.append(len(rows))
    return [(r.doc_id, r.source, redact(r.text or "")) for r in rows], stages


def test_run_equals_its_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect() if len(r.text.split()) > 60]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    near = texts[0].split()
    near[30] = "changed"
    planted = [
        (9001, None, "en", "web"), (9002, "", "en", None), (9003, " \n", "en", "web"), (9004, " ".join(near), "en", "web"), (9005, texts[1], "en", "planted"),
        (9005, texts[1], "en", "planted"), (9006, f"some words before it {item} and some after", "en", "web"), (9007, "AKIA" + "Q" * 16 + " and password: hunter2024 token=AKIA" + "Z" * 20, "en", "web"),
        (9008, "unlike any other " * 4000, "en", "hot"), (9009, "a" * 30_000, "en", "hot"), (9010, "single", "en", "hot"), (9010, "another text of that very id", "en", "hot"), (None, "a text that has no id", "en", "web"),
    ]
    whole = docs.unionByName(spark.createDataFrame([(*p, len(p[1] or "")) for p in planted], "doc_id long, text string, lang string, source string, n_chars long"))
    whole.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))

    read = [spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels", "benchmark")]
    want, kept = plain(read[0].collect(), read[1].collect(), read[2].collect(), toxicity.fit(read[0], read[1]))
    assert whole.count() > kept[0] > kept[1] > kept[2] > 0
    assert any("[SECRET]" in t for _, _, t in want)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.row, r.doc_id].append((r.text_start, r.length))
        bins[r.shard, r.bin].append(r)
    size = Counter()
    for (_, doc_id), ps in pieces.items():
        ps.sort()
        assert [s for s, _ in ps] == [sum(n for _, n in ps[:i]) for i in range(len(ps))]
        size[doc_id, sum(n for _, n in ps)] += 1
    assert size == Counter((i, len(t)) for i, _, t in want)
    source = {i: s for i, s, _ in want}
    for b in bins.values():
        b.sort(key=lambda r: (r.bin_start, r.length))
        assert [r.bin_start for r in b] == [sum(x.length for x in b[:i]) for i in range(len(b))]
        assert sum(r.length for r in b) <= 8192
        sources = [source[r.doc_id] for r in b if source[r.doc_id] is not None]
        assert len(set(sources)) == len(sources)
