"""Lifecycle of an image as an append-only event log, its current state, retries and retention.

Events: ``queued``, ``processing`` (an attempt starts), ``failed_attempt``, ``completed``, ``failed`` (the job's end)
and ``stalled``, with ``seq`` in order of happening. A row's attempts count starts; the queue's count failed
attempts. Repeated events (same image and seq) count once; a log may arrive in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom import schema as S
from frameloom.config import Config

STARTED, SUCCEEDED, ATTEMPT_FAILED, ENDED = "processing", "completed", "failed_attempt", "failed"


def backoff_ms(failures: Column, config: Config) -> Column:
    """Delay before the next attempt after so many failures: doubling from the base."""
    return (F.lit(config.backoff_ms) * F.pow(F.lit(2.0), failures - 1)).cast("bigint")


def queued(pending: DataFrame) -> DataFrame:
    """The first event of each new row; its number is fixed, so enqueuing a row again is a repeat."""
    return pending.select(F.col("id").alias("image_id"), F.lit(0).cast("bigint").alias("seq"), F.lit("queued").alias("event"), F.col("uploaded_at").alias("event_at"), F.lit(None).cast("string").alias("error")).dropDuplicates(["image_id"])


def once(events: DataFrame) -> DataFrame:
    return events.dropDuplicates(["image_id", "seq"])


def current(events: DataFrame, config: Config) -> DataFrame:
    """(image_id, status, attempts, failures, failure_reason, processing_started_at, processed_at, last_seq) per image.

    A completion decides, else the job's end or as many failed attempts as are allowed, else a start. One aggregation: no window and no sort of a whole image's history.
    """
    e = F.col("event")
    told = once(events).groupBy("image_id").agg(
        F.max("seq").alias("last_seq"),
        F.count_if(e == STARTED).cast("int").alias("attempts"),
        F.count_if(e == ATTEMPT_FAILED).cast("int").alias("failures"),
        F.max_by("event_at", F.when(e == STARTED, F.col("seq"))).alias("processing_started_at"),
        F.max(F.when(e == SUCCEEDED, F.col("seq"))).alias("_done"),
        F.max_by("event_at", F.when(e == SUCCEEDED, F.col("seq"))).alias("_done_at"),
        F.count_if(e == ENDED).alias("_ended"),
        F.max_by("event_at", F.when(e.isin(ATTEMPT_FAILED, ENDED), F.col("seq"))).alias("_failed_at"),
        F.max_by("error", F.when(e.isin(ATTEMPT_FAILED, ENDED), F.col("seq"))).alias("_error"),
    )
    done, spent = F.col("_done").isNotNull(), (F.col("failures") >= config.max_attempts) | (F.col("_ended") > 0)
    status = F.when(done, S.COMPLETED).when(spent, S.FAILED).when(F.col("attempts") > 0, S.PROCESSING).otherwise(S.PENDING)
    return told.select(
        "image_id", status.alias("status"), "attempts", "failures",
        F.when(~done & spent, F.substring("_error", 1, config.reason_length)).alias("failure_reason"),
        "processing_started_at", F.when(done, F.col("_done_at")).when(spent, F.col("_failed_at")).alias("processed_at"), "last_seq",
    )


def retry_schedule(events: DataFrame, config: Config) -> DataFrame:
    """(image_id, seq, failure_no, terminal, retry_at_ms): what each failed attempt leads to."""
    from pyspark.sql import Window

    order = Window.partitionBy("image_id").orderBy("seq")
    failures = once(events).where(F.col("event") == ATTEMPT_FAILED).withColumn("failure_no", F.row_number().over(order))
    terminal = F.col("failure_no") >= config.max_attempts
    at = F.unix_millis(F.col("event_at").cast("timestamp"))
    return failures.select("image_id", "seq", "failure_no", terminal.alias("terminal"), F.when(~terminal, at + backoff_ms(F.col("failure_no"), config)).alias("retry_at_ms"))


def retained(jobs: DataFrame, now: Column, config: Config) -> DataFrame:
    """Finished jobs the queue still keeps: done ones of the last hour, the newest thousand; failed ones of a day."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("processed_at").cast("timestamp"))
    done = jobs.where((F.col("status") == S.COMPLETED) & (age <= config.keep_done_s)).orderBy(F.desc("processed_at"), "image_id").limit(config.keep_done_rows)
    return done.unionByName(jobs.where((F.col("status") == S.FAILED) & (age <= config.keep_failed_s)))


def with_missing(jobs: DataFrame, images: DataFrame) -> DataFrame:
    """Jobs of images that don't exist are marked: their attempts fail and nothing is updated."""
    known = images.select(F.col("id").alias("image_id"), F.lit(True).alias("known")).distinct()
    return jobs.join(known, "image_id", "left").withColumn("missing", F.col("known").isNull()).drop("known")
