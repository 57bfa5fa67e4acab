"""The read queries over images, with typed errors, and the upload acknowledgement."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom import schema as S
from frameloom.config import Config

ID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
LIST_COLUMNS = ("id", "original_name", "stored_filename", "mime_type", "size_bytes", "status", "attempts", "uploaded_at", "processed_at", "failure_reason", "analysis_result")


class BadRequest(ValueError):
    """The id or a parameter is malformed."""


class NotFound(LookupError):
    """No such image."""


class NotReady(RuntimeError):
    """The image is in another state than the query needs."""

    def __init__(self, status: str):
        super().__init__(f"the image is {status}")
        self.status = status


@dataclass(frozen=True)
class Page:
    items: DataFrame
    total: int
    limit: int
    offset: int


def _number(value: str | int | None) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:
        return None


def page_bounds(limit: str | int | None, offset: str | int | None, config: Config) -> tuple[int, int]:
    """Absent, zero and non-numeric limits give the default, large ones the maximum; negatives are refused."""
    n, skip = _number(limit) or config.page_size, _number(offset) or 0
    if n < 0 or skip < 0:
        raise BadRequest("limit and offset must not be negative")
    return min(n, config.max_page), skip


def listed(images: DataFrame, status: str | None = None) -> DataFrame:
    """The listing's rows before paging: the filter reaches the scan, and only eleven columns are read."""
    if status and status not in S.STATUSES:
        raise BadRequest(f"unknown status {status!r}")
    return (images.where(F.col("status") == status) if status else images).select(*LIST_COLUMNS)


def list_images(images: DataFrame, status: str | None = None, limit=None, offset=None, config: Config = Config()) -> Page:
    """A page in order of upload, newest first, ids breaking ties, with the total under the same filter."""
    n, skip = page_bounds(limit, offset, config)
    rows = listed(images, status)
    return Page(rows.orderBy(F.desc("uploaded_at"), "id").offset(skip).limit(n), rows.count(), n, skip)


def _one(images: DataFrame, image_id: str) -> DataFrame:
    if not ID.fullmatch(image_id or ""):
        raise BadRequest("not an image id")
    return images.where(F.col("id") == image_id)


def _state(row: DataFrame) -> str:
    held = row.select("status").head(1)
    if not held:
        raise NotFound("no such image")
    return held[0].status


def status_columns() -> list[Column]:
    return [*map(F.col, ("id", "status", "attempts", "uploaded_at", "processing_started_at", "processed_at")), F.when(F.col("status") == S.FAILED, F.col("failure_reason")).alias("failure_reason")]


def status_of(images: DataFrame, image_id: str) -> DataFrame:
    row = _one(images, image_id)
    _state(row)
    return row.select(*status_columns())


def results_of(images: DataFrame, image_id: str) -> DataFrame:
    row = _one(images, image_id)
    if (status := _state(row)) != S.COMPLETED:
        raise NotReady(status)
    return row.select("id", "status", "processed_at", F.col("analysis_result").alias("analysis"))


def failure_of(images: DataFrame, image_id: str) -> DataFrame:
    row = _one(images, image_id)
    if (status := _state(row)) != S.FAILED:
        raise NotReady(status)
    return failed(row)


def completed(images: DataFrame) -> DataFrame:
    """What is ready to be read; a score that is not a number is none."""
    score = F.col("analysis_result.confidence_score")
    return images.where(F.col("status") == S.COMPLETED).select("id", "status", "processed_at", F.when(~F.isnan(score), score).alias("confidence_score"))


def failed(images: DataFrame) -> DataFrame:
    return images.where(F.col("status") == S.FAILED).select("id", "status", "attempts", "failure_reason")


def queue(images: DataFrame) -> DataFrame:
    return images.where(F.col("status").isin(S.PENDING, S.PROCESSING)).select("id", "status", "attempts", "uploaded_at")


def by_status(images: DataFrame) -> DataFrame:
    return images.groupBy("status").agg(F.count(F.lit(1)).alias("images"))


def acknowledged(pending: DataFrame) -> DataFrame:
    return pending.select("id", "status", "uploaded_at", F.lit("queued for analysis").alias("message"))


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"), F.current_timestamp().alias("at"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row, nulls left out."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def results_or_state(images: DataFrame, image_id: str) -> DataFrame | dict:
    """What a client shows: the results, or that they aren't ready yet and why."""
    try:
        return results_of(images, image_id)
    except NotReady as e:
        return {"notReady": True, "status": e.status}


def failure_or_none(images: DataFrame, image_id: str) -> DataFrame | None:
    try:
        return failure_of(images, image_id)
    except NotReady:
        return None


def unfinished(images: DataFrame) -> DataFrame:
    """The distinct images a client still polls."""
    return queue(images).select("id").distinct()
