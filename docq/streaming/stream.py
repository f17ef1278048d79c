"""Polling jobs as Structured Streaming: incremental collection of labels,
scoring of prediction files as they come, and the state of jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def collect_labels(
    spark: SparkSession, path: str, schema: str, key: str, modified: str, late: str | None = "10 minutes", cutoff: str | None = None, upto: tuple | None = None, include: tuple = ()
) -> DataFrame:
    """Saved label records (JSON lines under a folder) as a stream.

    With a cutoff, records modified after it, and besides those whose key is in the closed
    range `upto` or in `include`, however old.  With `late`, repeats of a key and
    time within the watermark are dropped, and records behind it; without it nothing is, and
    latest_into alone decides."""
    rows = spark.readStream.schema(schema).json(path)
    if cutoff is not None:
        wanted = F.col(modified) > F.lit(cutoff).cast("timestamp")
        wanted = wanted | F.col(key).between(*upto) if upto else wanted
        rows = rows.where(wanted | F.col(key).isin(*include) if include else wanted)
    return rows if late is None else rows.withWatermark(modified, late).dropDuplicatesWithinWatermark([key, modified])


def newest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is last in an order; ties by the whole row.  Combined before it is shuffled."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("r_")).select(key, "r_.*")


def latest_into(spark: SparkSession, out: str, key: str, modified: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: the newest version of each key, in a folder for each batch;
    a repeated batch writes its own folder again."""

    def write(batch: DataFrame, epoch: int) -> None:
        newest(batch, key, [modified]).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return write


def latest(spark: SparkSession, out: str, key: str, modified: str) -> DataFrame:
    """The newest version of each key over all batches."""
    return newest(spark.read.parquet(out), key, [modified, "batch"]).drop("batch")


def score_on_arrival(spark: SparkSession, path: str, schema: str, gt: DataFrame, on: str, out: str, checkpoint: str) -> StreamingQuery:
    """Score each prediction file once as it appears; ends when all there is has been read.
    schema: on, model, pred; gt: on, gt."""
    from docq.functions import metric

    p = spark.readStream.schema(schema).json(path)
    scored = p.join(gt, on).select(on, "model", metric.cer(F.col("gt"), F.col("pred")).alias("cer"))
    return scored.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").option("path", out).start()


class _Reached(Exception):
    """A batch beyond the stop."""


def score_until(spark: SparkSession, path: str, schema: str, gt: DataFrame, on: str, step: str, out: str, checkpoint: str, until: int | None = None) -> bool:
    """Score prediction files step by step as they have come, each once over all runs,
    and stop before the first file of a step beyond `until`; whether it was stopped.

    schema: on, step, pred; gt: on, gt.  out: on, step, cer, a folder for each batch, which a repeated batch
    writes again.  A file is a batch, the oldest first.  One beyond the stop is refused: it stays
    planned in the checkpoint and is the first of the next run, which may go further."""
    from docq.functions import metric

    def write(batch: DataFrame, epoch: int) -> None:
        if until is not None and (batch.agg(F.max(step)).first()[0] or 0) > until:
            raise _Reached
        batch.join(gt, on).select(on, step, metric.cer(F.col("gt"), F.col("pred")).alias("cer")).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(path)
    run = files.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    try:
        run.awaitTermination()
    except StreamingQueryException as e:
        if _Reached.__name__ not in str(e):
            raise
        return True
    return False


def job_status(events: DataFrame, job: str, status: str, ts: str) -> DataFrame:
    """The latest status of each job; for streams in update mode as well as for tables."""
    return events.groupBy(job).agg(F.max_by(status, ts).alias("status"), F.max(ts).alias("at"), F.count_if(F.col(status) == "failed").alias("failures"))


STATUS = "job string, status string, at_ms long, attempts int, failures string"


class JobStates(StatefulProcessor):
    """The state of each job from its events, which may come in any order within the watermark.

    pending, processing, completed, failed follow the events in order of time, then id.
    completed is final.  A failed attempt goes to the failure log; with a code
    of 429 or 5xx, while there are retries left, the job waits (retry) for
    backoff_ms, doubled with each failure, and is pending again when a timer on the
    event time says so; any other failure is final.  What comes after a
    final state is left out.

    Events behind the watermark are folded into the state for good (none can come
    before them); the others are kept until then.  A call of a job costs no data frame, and its
    state is one value, read once and written once.
    """

    def __init__(self, retries: int, backoff_ms: int):
        self.retries, self.backoff_ms = retries, backoff_ms

    def _fold(self, state: tuple, events: list[tuple]) -> tuple:
        for at, _, status, code in events:
            if state[0] in ("completed", "failed"):
                break
            before, _, attempts, failures = state
            if status == "failed":
                attempts, failures = attempts + 1, f"{failures},{code}" if failures else str(code)
                again = (code == 429 or 500 <= code < 600) and attempts <= self.retries
                status = "retry" if again else "failed"
            state = (status, at, attempts, failures)
        return state

    def _due(self, state: tuple) -> int:
        return state[1] + self.backoff_ms * 2 ** (state[2] - 1)

    def _row(self, key, state: tuple, now: int) -> Row:
        status = "pending" if state[0] == "retry" and self._due(state) <= now else state[0]
        return Row(job=key[0], status=status, at_ms=state[1], attempts=state[2], failures=state[3])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The folded state, the events (JSON) that wait, and the time of the job's timer, if it has one.
        self.held = handle.getValueState("held", "status string, at_ms long, attempts int, failures string, waiting string, timer long")

    def _get(self) -> tuple[tuple, list[tuple], int | None]:
        held = self.held.get()
        if held is None:
            return ("", 0, 0, ""), [], None
        *state, waiting, timer = held
        return tuple(state), [tuple(e) for e in json.loads(waiting)], timer

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        state, events, timer = self._get()
        events += ((r.at_ms, r.id, r.status, r.code or 0) for r in rows)
        events.sort(key=lambda e: e[:2])
        behind = [e for e in events if e[0] < now]
        state, rest = self._fold(state, behind), events[len(behind) :]
        last = self._fold(state, rest)
        due = self._due(last) if last[0] == "retry" and self._due(last) > now else None
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.held.update((*state, json.dumps(rest), due))
        yield self._row(key, last, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Spark drops the timer; deleting it again later, by the time that is held, does nothing.
        state, events, _ = self._get()
        yield self._row(key, self._fold(state, events), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def job_states(events: DataFrame, retries: int = 2, backoff_ms: int = 600_000, late: str = "1 hour") -> DataFrame:
    """job, status, at_ms, attempts, failures (codes in order, comma-joined): a row for each
    job that a batch or a timer moves, for update mode (JobStates).  events, a stream: job, id, ts,
    status, code.  Needs the RocksDB state store (state_store)."""
    rows = events.withWatermark("ts", late).select("job", "ts", F.unix_millis("ts").alias("at_ms"), F.col("id").cast("long").alias("id"), "status", F.col("code").cast("int").alias("code"))
    return rows.groupBy("job").transformWithState(statefulProcessor=JobStates(retries, backoff_ms), outputStructType=STATUS, outputMode="Update", timeMode="EventTime")


def state_store(spark: SparkSession) -> None:
    """The state store that keyed states with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def states_into(out: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of a batch's states, in a folder of its own; a repeated batch writes it again."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return write


def current_states(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each job over all batches."""
    return newest(spark.read.parquet(out), "job", ["batch"]).drop("batch")


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, late: str = "1 hour") -> DataFrame:
    """Rows of each key in tumbling windows, late rows within the watermark included."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
