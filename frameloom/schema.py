"""Row types of the domain and the fixed order of the checks."""

from __future__ import annotations

from pyspark.sql import types as T

# Names that reports carry, in the order in which a report lists them.
BLUR = "blur_detection"
BRIGHTNESS = "brightness_analysis"
DIMENSIONS = "dimension_validation"
DUPLICATE = "duplicate_detection"
SCREENSHOT = "screenshot_rephoto_heuristic"
METADATA = "metadata_analysis"
TAMPERING = "tampering_heuristic"
PLATE = "ocr_plate_validation"
CHECK_ORDER = (BLUR, BRIGHTNESS, DIMENSIONS, DUPLICATE, SCREENSHOT, METADATA, TAMPERING, PLATE)

# Lifecycle states and severities with their weights.
PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"
STATUSES = (PENDING, PROCESSING, COMPLETED, FAILED)
SEVERITY_WEIGHT = {"none": 0, "low": 1, "medium": 2, "high": 3}
MAX_WEIGHT = 3

# Accepted declared types and the extension each is stored under.
MIME_EXTENSION = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp"}

# Widths and heights of common screens, the smaller side first.
SCREENS = (
    (750, 1334), (768, 1366), (828, 1792), (1080, 1920), (1080, 2400), (1170, 2532), (1179, 2556),
    (1242, 2688), (1284, 2778), (1440, 2560), (1440, 2960), (1440, 3200), (2160, 3840),
)

CHECK = T.StructType(
    [
        T.StructField("check", T.StringType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("severity", T.StringType()),
        T.StructField("details_json", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)
REPORT = T.StructType(
    [
        T.StructField("overall_status", T.StringType()),
        T.StructField("issues_found", T.ArrayType(T.StringType())),
        T.StructField("checks", T.ArrayType(CHECK)),
        T.StructField("confidence_score", T.DoubleType()),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("original_name", T.StringType()),
        T.StructField("stored_filename", T.StringType()),
        T.StructField("storage_path", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("size_bytes", T.IntegerType()),
        T.StructField("uploaded_at", T.TimestampType()),
    ]
)
IMAGE = T.StructType(
    MANIFEST.fields
    + [
        T.StructField("status", T.StringType()),
        T.StructField("failure_reason", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("sha256_hash", T.StringType()),
        T.StructField("perceptual_hash", T.StringType()),
        T.StructField("ahash_hi", T.LongType()),
        T.StructField("ahash_lo", T.LongType()),
        T.StructField("processing_started_at", T.TimestampType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("analysis_result", REPORT),
    ]
)
JOB_EVENT = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("event_at", T.TimestampType()),
        T.StructField("error", T.StringType()),
    ]
)
EXIF = T.StructType(
    [
        T.StructField("make", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("captured_at", T.StringType()),
        T.StructField("gps_latitude", T.DoubleType()),
        T.StructField("software", T.StringType()),
        T.StructField("tag_count", T.IntegerType()),
    ]
)
HEADER = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("format", T.StringType()),
        T.StructField("exif", EXIF),
        T.StructField("header_error", T.StringType()),
    ]
)
PIXELS = T.StructType(
    [
        T.StructField("laplacian_var", T.DoubleType()),
        T.StructField("resized_to", T.StringType()),
        T.StructField("mean_red", T.DoubleType()),
        T.StructField("mean_luma", T.DoubleType()),
        T.StructField("thumb8x8", T.ArrayType(T.IntegerType())),
        T.StructField("ela_sum", T.LongType()),
        T.StructField("ela_n", T.LongType()),
        T.StructField("ela_max", T.IntegerType()),
        T.StructField("pixel_error", T.StringType()),
    ]
)
