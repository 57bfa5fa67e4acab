"""What the dashboard shows of a page of images: counts, labels, tags, plate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom import schema as S
from frameloom.functions.columns import age_label, confidence_band, mime_badge, size_label

# Display names of the checks.
CHECK_LABELS = {
    S.BLUR: "SHARPNESS", S.BRIGHTNESS: "EXPOSURE", S.DIMENSIONS: "RESOLUTION", S.DUPLICATE: "DUPLICATE",
    S.SCREENSHOT: "SCREENSHOT", S.METADATA: "METADATA", S.TAMPERING: "TAMPERING", S.PLATE: "PLATE",
}
TAGS = 3


def counts(page: DataFrame) -> DataFrame:
    """Completed, flagged and active rows of what is passed in: a page, or the whole table for the global view."""
    return page.agg(
        F.count(F.lit(1)).alias("shown"),
        F.count_if(F.col("status") == S.COMPLETED).alias("completed"),
        F.count_if((F.col("status") == S.COMPLETED) & (F.col("analysis_result.overall_status") == "flagged")).alias("flagged"),
        F.count_if(F.col("status").isin(S.PENDING, S.PROCESSING)).alias("active"),
    )


def check_label(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CHECK_LABELS.items() for x in pair])
    return F.coalesce(known[name], F.upper(F.replace(name, F.lit("_"), F.lit(" "))))


def failed_tags(checks: Column) -> Column:
    """Name (first underscore as a blank) and severity of the first failed checks, in report order."""
    first = F.slice(F.filter(checks, lambda c: c.isNotNull() & ~c["passed"]), 1, TAGS)
    return F.transform(first, lambda c: F.concat(F.regexp_replace(c["check"], "^([^_]*)_", "$1 "), F.lit(":"), F.coalesce(c["severity"], F.lit("low"))))


def plate_of(checks: Column) -> Column:
    """The plate of a passed plate check; null without one."""
    passed = F.filter(checks, lambda c: (c["check"] == S.PLATE) & c["passed"])
    plate = F.get_json_object(F.get(passed, F.lit(0))["details_json"], "$.extractedPlate")
    return F.when(plate != "", plate)


def cards(images: DataFrame, now: Column) -> DataFrame:
    r = F.col("analysis_result")
    return images.select(
        "id", "status", mime_badge(F.col("mime_type")).alias("badge"), size_label(F.col("size_bytes")).alias("size"), age_label(F.col("uploaded_at"), now).alias("age"),
        F.floor(r["confidence_score"] * 100 + 0.5).alias("confidence"), confidence_band(r["confidence_score"]).alias("band"),
        failed_tags(r["checks"]).alias("tags"), plate_of(r["checks"]).alias("plate"),
    )
