"""Structured Streaming: files to reports, deduplicated jobs, and the retry state machine."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom import schema as S
from frameloom.config import Config
from frameloom.operators.lifecycle import ATTEMPT_FAILED, ENDED, STARTED, SUCCEEDED, queued
from frameloom.sources import ingest

#: ``seen`` and ``failed`` list the numbers of an image's events and failed attempts so far, ``told`` that of the event the reason is from.
RETRY_STATE = "seen string, failed string, attempts int, done boolean, ended boolean, told bigint, reason string"
RETRY_OUT = "image_id string, seq bigint, events int, status string, attempts int, failures int, delay_ms bigint, failure_reason string"

# Fixed value: the columns of the binary file source.
FILE = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, directory: str, per_trigger: int = 64) -> DataFrame:
    """New files of a directory, as they arrive; a bounded number each trigger."""
    return spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", per_trigger).load(directory)


def event_stream(spark: SparkSession, directory: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(S.JOB_EVENT).option("maxFilesPerTrigger", per_trigger).parquet(directory)


def distinct_jobs(jobs: DataFrame, late: str = "1 hour", id_col: str = "image_id", time_col: str = "event_at") -> DataFrame:
    """Each image is enqueued once, however often it is announced within the lateness."""
    return jobs.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])


def retries(events: DataFrame, config: Config, late: str = "1 day") -> DataFrame:
    """State machine per image over its job events: attempts, failures, and the delay or end each failure leads to.

    Events may arrive in any order within the lateness: what an image has seen is kept by ``seq``, so a repeat counts once, a late
    event counts when it comes, and after the last one the answer is that of ``lifecycle.current``. ``events`` counts them; the row with most is the newest.
    A failure's delay follows its place among the failures by ``seq``. State of a
    finished job expires after the retention time of its outcome, in event time: a replay gives the same
    answer whenever it runs, and a bounded run ends (timers of the wall clock would keep it going).
    """
    limit, base, cut = config.max_attempts, config.backoff_ms, config.reason_length
    keep = {S.COMPLETED: config.keep_done_s * 1000, S.FAILED: config.keep_failed_s * 1000}
    numbers = lambda text: {int(n) for n in text.split(",") if n}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, failed, attempts, done, ended, told, reason = state.get if state.exists else ("", "", 0, False, False, -1, None)
        seen, failed = numbers(seen), numbers(failed)
        out, arrived = [], pd.concat(list(batches)).sort_values("seq")
        newest = int(arrived["event_at"].max().timestamp() * 1000)
        for e in arrived.itertuples(index=False):
            seq, delay = int(e.seq), None
            if seq in seen:
                continue
            seen.add(seq)
            attempts += e.event == STARTED
            done |= e.event == SUCCEEDED
            ended |= e.event == ENDED
            if e.event in (ATTEMPT_FAILED, ENDED) and seq > told:
                told, reason = seq, e.error[:cut] if isinstance(e.error, str) else None
            if e.event == ATTEMPT_FAILED:
                failed.add(seq)
                number = sum(n <= seq for n in failed)
                delay = base * 2 ** (number - 1) if number < limit else None
            spent = ended or len(failed) >= limit
            status = S.COMPLETED if done else S.FAILED if spent else S.PROCESSING if attempts else S.PENDING
            out.append((key[0], seq, len(seen), status, attempts, len(failed), delay, reason if spent and not done else None))
        joined = lambda held: ",".join(map(str, sorted(held)))
        state.update((joined(seen), joined(failed), attempts, done, ended, told, reason))
        end = S.COMPLETED if done else S.FAILED if ended or len(failed) >= limit else None
        if end:
            state.setTimeoutTimestamp(max(newest + keep[end], state.getCurrentWatermarkMs() + 1))
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in RETRY_OUT.split(", ")])
            frame["delay_ms"] = frame["delay_ms"].astype("Int64")
            yield frame

    timed = events.withWatermark("event_at", late).groupBy("image_id")
    return timed.applyInPandasWithState(step, RETRY_OUT, RETRY_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stop_on_signal(*queries: StreamingQuery, number: int = signal.SIGTERM) -> None:
    """A termination signal stops the queries; the batch under way is repeated from its checkpoint at the next start."""

    def stop(*_) -> None:
        for query in queries:
            query.stop()

    signal.signal(number, stop)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything there is now, batch by batch, with a checkpoint that a restart continues from."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(path: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """A sink that is idempotent by batch: a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def ingest_stream(spark: SparkSession, directory: str, manifest: DataFrame, sink: str, checkpoint: str, config: Config, per_trigger: int = 64) -> StreamingQuery:
    """New files become pending rows with features and ``queued`` events, refused ones rows with a reason; a repeated batch overwrites its own folders.

    The names of one batch, at most ``per_trigger`` of them, are filters on the manifest's scan.
    """

    def each(batch: DataFrame, number: int) -> None:
        paths = [(r.path, r.name) for r in batch.select("path", ingest.file_name(F.col("path")).alias("name")).collect()]
        if not paths:
            return
        named = manifest.where(F.col("stored_filename").isin([n for _, n in paths]))
        pending, refused = ingest.ingest(spark, named, [p for p, _ in paths], config)
        pending.write.mode("overwrite").parquet(f"{sink}/pending/batch={number}")
        kept = spark.read.parquet(f"{sink}/pending/batch={number}")
        # A job is enqueued after its row with both hashes stands, so that jobs running at once see each other.
        queued(kept).write.mode("overwrite").parquet(f"{sink}/events/batch={number}")
        refused.write.mode("overwrite").parquet(f"{sink}/refused/batch={number}")

    return run_batches(file_stream(spark, directory, per_trigger).select("path"), each, checkpoint)
