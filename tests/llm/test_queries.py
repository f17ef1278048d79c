"""Queries that SQL cannot express, against plain versions of themselves."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from docq.llm import queries as q

SF = "/root/testdata/sf0.01"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_toxicity_held_out(spark):
    got = q.op4_toxicity(spark, SF).collect()
    label = {r.doc_id: r.toxic for r in rows(spark, "labels")}
    docs = {r.doc_id for r in rows(spark, "documents")}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in label]
    right = np.mean([r.predicted == label[r.doc_id] for r in held])
    caught = [r.predicted for r in held if label[r.doc_id]]
    assert right > 0.95 and np.mean(caught) > 0.75


def test_packing_keeps_every_character_and_no_conflict(spark):
    got = q.op5_packing(spark, SF).collect()
    docs = {r.doc_id: r for r in rows(spark, "documents")}
    seen, bins = defaultdict(list), defaultdict(list)
    for r in got:
        seen[r.doc_id].append((r.text_start, r.length))
        bins[r.shard, r.bin].append(r)
    assert set(seen) == set(docs)
    for i, pieces in seen.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == len(docs[i].text or "")
    fill = 0
    for b in bins.values():
        assert len({docs[r.doc_id].source for r in b}) == len(b)
        assert len({docs[r.doc_id].text for r in b}) == len(b)
        at = 0
        for r in sorted(b, key=lambda r: (r.bin_start, r.length)):
            assert r.bin_start == at
            at += r.length
        assert at <= 8192
        fill += at
    assert fill / len(bins) / 8192 > 0.85


def test_neighbours_recall(spark):
    got = defaultdict(list)
    for r in q.op6_neighbours(spark, SF).collect():
        got[r.query_id].append(r)
    data = rows(spark, "embeddings")
    ids = np.array([r.vec_id for r in data])
    x = np.array([r.embedding for r in data], dtype=float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        cos = unit @ unit[i]
        best = sorted((-c, v) for c, v in zip(cos, ids) if v != ids[i])[:5]
        mine = sorted(got[ids[i]], key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        for r in mine:
            assert abs(r.score - cos[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-9
        found += len({v for _, v in best} & {r.vec_id for r in mine})
        total += 5
    assert found / total >= 0.9


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base_spans(spark):
    got = {r.doc_id: r for r in q.op8_pii(spark, SF).collect()}
    docs = rows(spark, "documents")
    assert len(got) == len(docs)
    n = 0
    for d in docs:
        want = personal(d.text or "")
        n += len(want)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in BASE]
        assert set(want) <= set(r.spans.split(","))
    assert n > 20


def test_sharding_law(spark):
    got = q.op9_sharding(spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in rows(spark, "documents")}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    ids = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.1


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(q.tokenizer())
    got = {r.doc_id: r for r in q.op10_tokens(spark, SF).collect()}
    at = 0
    for d in sorted(rows(spark, "documents"), key=lambda r: r.doc_id):
        ids = tok.encode(d.text or "", add_special_tokens=False).ids + [2]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
