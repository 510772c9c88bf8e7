"""Job queue as streams: acceptance, processing with retries, progress, stalls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ranking import first_per_key
from ..sources.store import JOB_SCHEMA, TERMINAL, latest_jobs

ATTEMPTS, DELAY_SECONDS, MOST_DELAY = 3, 5, 60
THROTTLE_MS, PROGRESS_CAP = 750, 97
MISSING_SECONDS, QUEUED_SECONDS, STALLED_SECONDS = 30, 45, 90


def read_queue(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Job messages that arrive as JSON files."""
    return spark.readStream.schema(JOB_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def accept(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Requests with ``answer``: accepted, repeated (same id and input), or conflict (same id, other input)."""
    known = latest_jobs(held).select("client_id", "job_id", F.col("input").alias("held_input"))
    w = Window.partitionBy("client_id", "job_id").orderBy("created_at", "input")
    rows = requests.join(known, ["client_id", "job_id"], "left").withColumn("_first", F.first("input").over(w)).withColumn("_n", F.row_number().over(w))
    before = F.coalesce("held_input", "_first")
    answer = F.when(F.col("held_input").isNull() & (F.col("_n") == 1), "accepted").when(F.col("input") == before, "repeated").otherwise("conflict")
    return rows.withColumn("answer", answer).drop("held_input", "_first", "_n")


def retry_delay(attempt: Column) -> Column:
    """Seconds before the next attempt."""
    return F.least(attempt * DELAY_SECONDS, F.lit(MOST_DELAY))


def pending(messages: DataFrame, results: DataFrame) -> DataFrame:
    """Messages, once per job, of jobs that have no final result and attempts left; with ``attempt``."""
    done = results.where(F.col("status").isin(*TERMINAL) & (F.col("final"))).select("client_id", "job_id").distinct()
    tried = results.groupBy("client_id", "job_id").agg(F.max("attempt").alias("tried"))
    rows = messages.dropDuplicates(["client_id", "job_id"]).join(done, ["client_id", "job_id"], "left_anti").join(tried, ["client_id", "job_id"], "left")
    return rows.withColumn("attempt", F.coalesce("tried", F.lit(0)) + 1).drop("tried").where(F.col("attempt") <= ATTEMPTS)


def due(results: DataFrame, now: Column) -> DataFrame:
    """The messages of jobs whose last attempt failed, is not final, and waited its delay."""
    last = first_per_key(results, ["client_id", "job_id"], [F.desc("attempt")])
    waited = (F.unix_micros(now) - F.unix_micros("tried_at")) / F.lit(1e6) >= retry_delay(F.col("attempt"))
    failed = last.where((F.col("status") == "failed") & ~F.col("final") & F.col("message").isNotNull() & waited)
    return failed.select(F.from_json("message", JOB_SCHEMA).alias("m")).select("m.*")


def with_heartbeat(queue: DataFrame) -> DataFrame:
    """The queue with a row without a job every second, so that batches run, and failed jobs are tried again, while it is empty."""
    beat = queue.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    return queue.unionByName(beat.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in queue.schema.fields]))


RESULT_SCHEMA = "client_id string, job_id string, status string, error string, attempt int, final boolean, message string, tried_at timestamp, batch long"


def consume(queue: DataFrame, run: Callable[[DataFrame], DataFrame], results_path: str, checkpoint: str, trigger: dict | None = None, clock: Callable[[], Column] = F.current_timestamp) -> StreamingQuery:
    """Process every batch of messages once: ``run`` gives status and error; results are added to a table.

    Jobs of the table that failed and are due join each batch, so a job needs no second message; over
    ``with_heartbeat`` with a processing-time trigger they are also tried while no message comes.  The batch
    number is part of the results, and a batch that is replayed after a failure replaces its own, so that a
    job is not counted twice.  A failure after the last attempt is final.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            before = spark.read.schema(RESULT_SCHEMA).parquet(results_path).where(F.col("batch") != number)
        except Exception as e:  # the table begins with the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = spark.createDataFrame([], RESULT_SCHEMA)
        messages = batch.where(F.col("job_id").isNotNull())
        work = pending(messages.unionByName(due(before, clock()).select(*messages.columns)), before)
        work = work.withColumn("message", F.to_json(F.struct(*messages.columns)))
        if work.isEmpty():
            return
        done = run(work)
        final = (F.col("status") != "failed") | (F.col("attempt") >= ATTEMPTS)
        out = done.select("client_id", "job_id", "status", "error", "attempt", final.alias("final"), "message", clock().alias("tried_at"))
        out.write.mode("overwrite").parquet(f"{results_path}/batch={number}")

    return queue.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch(updates: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """A stream (job_id, stall) of jobs that fell silent, from a stream of updates (job_id, status).

    A timer per job is set by each update; silence alone fires it: "missing" for a job that was only
    announced (no status), "queued" and "stalled" for those that wait or run.  A final status clears it.  A
    job is reported once and again only after another update.  ``limits`` are seconds by kind.
    """
    limits = {"missing": MISSING_SECONDS, "queued": QUEUED_SECONDS, "stalled": STALLED_SECONDS} | (limits or {})
    kinds = {None: "missing", "queued": "queued", "running": "stalled"}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (kind,) = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "stall": [kind]})
            return
        status = None
        for pdf in batches:
            for value in pdf["status"]:
                status = value if isinstance(value, str) else None
        if status in kinds:
            state.update((kinds[status],))
            state.setTimeoutDuration(limits[kinds[status]] * 1000)
        elif state.exists:
            state.remove()

    return updates.groupBy("job_id").applyInPandasWithState(step, "job_id string, stall string", "kind string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def checkpoints(updates: DataFrame) -> DataFrame:
    """Updates worth storing: queued, awaiting-3d or failed, with content that differs from the job's one before."""
    w = Window.partitionBy("client_id", "job_id").orderBy("updated_at")
    signature = F.sha2(F.to_json(F.struct("status", "progress_percent", "error")), 256)
    rows = updates.where(F.col("status").isin("queued", "awaiting-3d", "failed")).withColumn("_s", signature)
    return rows.withColumn("_b", F.lag("_s").over(w)).where(F.col("_b").isNull() | (F.col("_b") != F.col("_s"))).drop("_s", "_b")


def current_generation(updates: DataFrame, keys: list[str], generation: str = "generation") -> DataFrame:
    """Updates of the newest generation per key."""
    newest = updates.groupBy(*keys).agg(F.max(generation).alias(generation))
    return updates.join(newest, [*keys, generation], "left_semi")


def stalled(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs with ``stall``: missing, queued or stalled for too long, else null."""
    age = (F.unix_micros(now) - F.unix_micros(F.coalesce("updated_at", "created_at"))) / F.lit(1e6)
    kind = (
        F.when(F.col("status").isNull() & (age > MISSING_SECONDS), "missing").when((F.col("status") == "queued") & (age > QUEUED_SECONDS), "queued")
        .when((F.col("status") == "running") & (age > STALLED_SECONDS), "stalled")
    )
    return jobs.withColumn("stall", kind)


def throttle_progress(updates: DataFrame) -> DataFrame:
    """A stream of (job_id, at, percent) thinned to one in 750 ms per job, never falling, at most 97."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent_ms, top = state.get if state.exists else (None, 0)
        rows = []
        for pdf in batches:
            for at, percent in zip(pdf["at"], pdf["percent"], strict=True):
                ms = int(at.value // 1_000_000)
                rows.append((ms, min(PROGRESS_CAP, int(percent))))
        out = []
        for ms, percent in sorted(rows):
            top = max(top, percent)
            if sent_ms is None or ms - sent_ms >= THROTTLE_MS:
                sent_ms = ms
                out.append((key[0], pd.Timestamp(ms, unit="ms", tz="UTC"), top))
        state.update((sent_ms, top))
        yield pd.DataFrame(out, columns=["job_id", "at", "percent"])

    return updates.groupBy("job_id").applyInPandasWithState(
        step, "job_id string, at timestamp, percent int", "sent_ms long, top int", "append", GroupStateTimeout.NoTimeout
    )


def stage_counters(events: DataFrame) -> DataFrame:
    """Rows and seconds per stage of a search."""
    return events.groupBy("stage").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"))


def network_summary(events: DataFrame) -> DataFrame:
    """Events by kind, a column per category."""
    return events.groupBy("kind").pivot("category", ["cache-hit", "network", "shared", "failed"]).count().na.fill(0)
