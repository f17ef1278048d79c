"""Queries that write the given tables as files, stream them and read the outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from docq.operators.lineage import folder
from docq.plans.catalog import READS, query, reads, t
from docq.plans.q_data import _CER
from docq.streaming import stream

# Events as saved labels of users; a record counts if it is new enough, or its key was asked for.
CUTOFF = "2024-01-12 00:00:00"


@query(
    "str01_collect_labels",
    f"""SELECT user_id, modified, label FROM (SELECT user_id, ts AS modified, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS r
FROM events WHERE ts > TIMESTAMP '{CUTOFF}' OR user_id BETWEEN 10 AND 12 OR user_id IN (3, 5)) WHERE r = 1""",
)
def str01(spark, d):
    root = folder(spark, "labels")
    saved = t(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("modified"), F.col("event_type").alias("label"), (F.col("event_id") % 2).alias("half"))
    for half in (1, 0):
        saved.where(F.col("half") == half).drop("half").write.mode("append").json(f"{root}/in")
        rows = stream.collect_labels(spark, f"{root}/in", "user_id long, modified timestamp, label string", "user_id", "modified", None, CUTOFF, (10, 12), (3, 5))
        write = stream.latest_into(spark, f"{root}/out", "user_id", "modified")
        rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.latest(spark, f"{root}/out", "user_id", "modified")


@query(
    "str02_score_on_arrival",
    f"WITH {READS} SELECT id, CAST(id % 5 AS INT) AS step, round({_CER}, 6) AS cer FROM reads WHERE id % 5 <= 3",
)
def str02(spark, d):
    """Readings come as files of five steps; two runs, the second stops after the step of 3."""
    root = folder(spark, "scores")
    r = reads(spark, d)
    preds = r.select("id", (F.col("id") % 5).cast("int").alias("step"), "pred")
    for steps in ((0, 1), (2, 3, 4)):
        for step in steps:
            preds.where(F.col("step") == step).write.mode("append").json(f"{root}/in")
        stream.score_until(spark, f"{root}/in", "id long, step int, pred string", r.select("id", "gt"), "id", "step", f"{root}/out", f"{root}/checkpoint", until=3)
    return spark.read.parquet(f"{root}/out").select("id", "step", F.round("cer", 6).alias("cer"))


# Events of a user in a week as those of a job.
_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END"
_CODE = "CASE WHEN event_type <> 'error' THEN 0 WHEN event_id % 3 = 0 THEN 429 WHEN event_id % 3 = 1 THEN 503 ELSE 404 END"


@query(
    "str03_job_states",
    f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(epoch_us(ts) // 604800000000 AS VARCHAR) AS job, event_id, epoch_us(ts) // 1000 AS ms, {_STATUS} AS status, {_CODE} AS code FROM events),
n AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (status = 'failed') OVER w AS f FROM e WINDOW w AS (PARTITION BY job ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, status = 'completed' OR status = 'failed' AND (code = 404 OR f > 2) AS final FROM n),
k AS (SELECT *, max(n) OVER (PARTITION BY job) AS last FROM (SELECT *, min(CASE WHEN final THEN n END) OVER (PARTITION BY job) AS stop FROM s) WHERE stop IS NULL OR n <= stop)
SELECT job, any_value(ms) FILTER (n = last) AS at_ms, CAST(count(*) FILTER (status = 'failed') AS INT) AS attempts, coalesce(string_agg(code, ',' ORDER BY n) FILTER (status = 'failed'), '') AS failures,
  any_value(CASE WHEN status <> 'failed' OR final THEN status WHEN ms + 600000 * 2 ** (f - 1) <= (SELECT max(epoch_us(ts) // 1000) - 3600000 FROM events) THEN 'pending' ELSE 'retry' END) FILTER (n = last) AS status
FROM k GROUP BY job""",
)
def str03_states(spark, d):
    """Jobs in two runs over one checkpoint, the earlier events first; failed calls wait and come back by timers."""
    root = folder(spark, "jobs")
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    job = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.expr("unix_millis(ts) div 604800000").cast("string"))
    rows = e.select(job.alias("job"), F.col("event_id").alias("id"), "ts", F.expr(_STATUS).alias("status"), F.expr(_CODE).alias("code"))
    stream.state_store(spark)
    for part in ("ts < '2024-01-15'", "ts >= '2024-01-15'"):
        rows.where(part).write.mode("append").parquet(f"{root}/in")
        states = stream.job_states(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
        states.writeStream.foreachBatch(stream.states_into(f"{root}/out")).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.current_states(spark, f"{root}/out").select("job", "status", "at_ms", "attempts", "failures")
