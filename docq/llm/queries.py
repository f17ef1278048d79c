"""Queries of the operators of this subpackage, with SQL where it can express them.

Each query reads whole tables, calls one operator and derives the digest
columns of its result from what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docq.llm import ann, chat, conversation_repair, decontam, hard_negatives, minhash, packing, pii, quality, secret_scan, sharding, token_files, toxicity
from docq.llm.spans import written

END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, threshold=0.8).drop("key", "cluster")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window_words=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha(names).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns.unionByName(extra), tokenizer())
    read = chat.read_conversations(formatted)
    turns_text = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), sha(turns_text).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"), "formatted_chars",
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r.kind) for r in secret_scan.BASE], sha(written(base)).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in pii.BASE_KINDS], sha(written(base)).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.external_shuffle(table(spark, sf_dir, "documents"), shards=16)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, documents = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer(), END_ID)
    return token_files.read_tokens(out, documents)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: conversations with planted faults, by a hash of conversation and turn."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind, text = F.crc32(name.cast("binary")) % 20, F.coalesce("text", F.lit(" "))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (kind == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("again"),
    ).drop("again")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = conversation_repair.repair(damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"))
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return fixed.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", sha(text).alias("repaired_sha256"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_decontamination": op2_decontamination,
    "op3_chat": op3_chat,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_neighbours": op6_neighbours,
    "op7_secrets": op7_secrets,
    "op8_pii": op8_pii,
    "op9_sharding": op9_sharding,
    "op10_tokens": op10_tokens,
    "op11_quality": op11_quality,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN ws IS NULL OR len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS t FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.t)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.t) AS component_id, d.doc_id = min(r.t) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""

SQL2 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, unnest(list_transform(range(1, greatest(1, len(ws) - 9) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) AS win
  FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM i),
p AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS pos, ws FROM d, sizes WHERE len(ws) >= n),
h AS (SELECT p.doc_id, p.pos, p.n, i.item_id FROM (SELECT doc_id, pos, n, array_to_string(ws[pos:pos + n - 1], ' ') AS win FROM p) p JOIN i ON p.win = i.win AND p.n = i.n),
c AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS w FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_CONTROL = "|".join(
    "{}\\\\*{}".format(*(x.replace("[", r"\[").replace("]", r"\]").replace("|", r"\|") for x in (c[0], c[1:]))) for c in chat.CONTROL
)
SQL3 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.OPEN) + len(chat.CLOSE) + 2} + length(role) + length(text) + len(regexp_extract_all(text, '{_CONTROL}'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_any_case(w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))
_ASSIGN = rf"({_KEYS})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"


def _matches(name: str, rank: int, pattern: str, ok: str, lead: str = "''") -> str:
    """Kept matches of a pattern: doc_id, rank, kind, s, e.  lead: what of a match stands before the span."""
    return rf"""
SELECT doc_id, {rank} AS rank, '{name}' AS kind,
  CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) + length({lead}) AS BIGINT) AS s, length(m) - length({lead}) AS n
FROM (SELECT *, ms[i] AS m FROM (SELECT doc_id, ps, ms, unnest(range(1, len(ms) + 1)) AS i FROM (
  SELECT doc_id, string_split_regex(text, '{pattern}') AS ps, regexp_extract_all(text, '{pattern}') AS ms FROM documents WHERE text IS NOT NULL))) WHERE {ok}"""


SQL7 = rf"""
WITH m AS ({_matches('assign', 0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")}
UNION ALL {_matches('access', 1, 'AKIA[A-Z0-9]+', 'length(m) >= 20')}
UNION ALL {_matches('hex', 2, '[0-9a-f]+', 'length(m) >= 24')}
UNION ALL {_matches('pem', 3, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----', 'true')}
UNION ALL {_matches('jwt', 4, '(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}', 'true', "CASE WHEN starts_with(m, 'eyJ') THEN '' ELSE '-' END")}
UNION ALL {_matches('forge', 5, '(?:^|[^A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}', 'true', "CASE WHEN starts_with(m, 'gh') THEN '' ELSE '-' END")}),
t AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans
  FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN t USING (doc_id)
"""

SQL12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

# The checksum of a key, bit by bit; then, row after row, the cheapest edits that lead to each state of the pattern.
SQL13 = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)),
    CAST(4294967295 AS BIGINT)) % 20 AS d FROM k),
r AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r),
p AS (
  SELECT *, left(role, 1) AS c, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM o),
s AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, unnest([{'q': 0, 'm': {'cost': 0, 'audit': '', 'said': ''}}, {'q': 2, 'm': {'cost': 2, 'audit': 'I', 'said': chr(10) || 'user:'}},
    {'q': 3, 'm': {'cost': 4, 'audit': 'II', 'said': chr(10) || 'user:' || chr(10) || 'assistant:'}}], recursive := false) AS x FROM p
  UNION ALL
  SELECT conv_id, i, {'q': q, 'm': min({'cost': cost, 'audit': audit, 'said': said})} FROM (
    SELECT conv_id, i, y.q AS q, cost + y.cost AS cost, audit || y.audit AS audit, said || y.said AS said FROM (
      SELECT conv_id, i, e.q AS q, cost + e.cost AS cost, audit || e.audit AS audit, said || e.said AS said,
        unnest(CASE WHEN e.q = 2 THEN [{'q': 2, 'cost': 0, 'audit': '', 'said': ''}, {'q': 3, 'cost': 2, 'audit': 'I', 'said': chr(10) || 'assistant:'}]
          ELSE [{'q': e.q, 'cost': 0, 'audit': '', 'said': ''}, {'q': 2, 'cost': 2, 'audit': 'I', 'said': chr(10) || 'user:'},
            {'q': 3, 'cost': 4, 'audit': 'II', 'said': chr(10) || 'user:' || chr(10) || 'assistant:'}] END) AS y
      FROM (
        SELECT s.conv_id, p.i, s.x.m.cost AS cost, s.x.m.audit AS audit, s.x.m.said AS said,
          unnest(list_concat([{'q': s.x.q, 'cost': 3, 'audit': 'D', 'said': ''}], CASE WHEN fault IN ('b', 'd') THEN [] ELSE list_filter([
            {'q': CASE WHEN s.x.q = 0 AND c = 's' THEN 1 WHEN s.x.q <> 2 AND c = 'u' THEN 2 WHEN s.x.q = 2 AND c = 'a' THEN 3 ELSE -1 END, 'cost': CASE WHEN fault = 't' THEN 1 ELSE 0 END, 'audit': 'K', 'said': chr(10) || role || ':' || text},
            {'q': CASE WHEN s.x.q = 2 THEN 3 ELSE 2 END, 'cost': CASE WHEN fault = 't' THEN 3 ELSE 2 END, 'audit': 'R', 'said': chr(10) || CASE WHEN s.x.q = 2 THEN 'assistant' ELSE 'user' END || ':' || text}],
            lambda z: z.q >= 0) END)) AS e
        FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = s.i + 1))) GROUP BY conv_id, i, q),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM p GROUP BY conv_id),
best AS (SELECT n.conv_id, min(s.x.m) AS m FROM n JOIN s ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.i = n.n AND s.x.q IN (0, 3) GROUP BY n.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(m.cost, 0) AS BIGINT) AS cost, coalesce(m.audit, '') AS audit, sha256(coalesce(m.said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN best ON a.conv_id IS NOT DISTINCT FROM best.conv_id
"""

SQL = {"op1_minhash": SQL1, "op2_decontamination": SQL2, "op3_chat": SQL3, "op7_secrets": SQL7, "op12_hard_negatives": SQL12, "op13_conversation_repair": SQL13}
