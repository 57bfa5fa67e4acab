"""The per-image checks as Columns over a feature row, and the registry they are looked up in.

A check turns features into one struct (check, passed, severity, details_json, message). It never
reads another row; the duplicate check is joined in beforehand (``operators.duplicates``). A feature error
becomes a failed check of low severity for that check alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom import schema as S
from frameloom.config import DOCUMENTED, Config
from frameloom.functions.columns import fixed, half_up
from frameloom.operators import plates

SUSPICIOUS_SOFTWARE = "(?i)photoshop|gimp|snapseed|screenshot"


def details(**fields: Column) -> Column:
    """JSON object with explicit nulls."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def verdict(name: str, passed: Column, severity: Column, details_json: Column, message: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check"),
        passed.cast("boolean").alias("passed"),
        F.when(passed, F.lit("none")).otherwise(severity).alias("severity"),
        details_json.alias("details_json"),
        message.alias("message"),
    )


def isolated(name: str, error: Column, result: Column) -> Column:
    """The check's result, or its low-severity failure where the features could not be had."""
    failure = verdict(name, F.lit(False), F.lit("low"), details(error=error), F.concat(F.lit("check could not run: "), error))
    return F.when(error.isNotNull(), failure).otherwise(result)


def blur(c: Config) -> Column:
    variance = F.col("laplacian_var")
    passed = variance >= c.blur_threshold
    return verdict(
        S.BLUR, passed, F.lit("high"),
        details(laplacianVariance=half_up(variance, 2), threshold=F.lit(c.blur_threshold), resizedTo=F.col("resized_to")),
        F.when(passed, "edges are sharp enough").otherwise(F.concat(F.lit("edges are too soft, probably blurred: variance "), fixed(variance, 1), F.lit(f" below {c.blur_threshold}"))),
    )


def brightness(c: Config) -> Column:
    mean = F.col("mean_luma") if c.profile == DOCUMENTED else F.col("mean_red")
    dark, bright = mean < c.low_light, mean > c.overexposed
    return verdict(
        S.BRIGHTNESS, ~(dark | bright), F.lit("medium"),
        details(meanBrightness=half_up(mean, 2), lowThreshold=F.lit(c.low_light), highThreshold=F.lit(c.overexposed)),
        F.when(dark, F.concat(F.lit("too little light: mean "), fixed(mean, 1))).when(bright, F.concat(F.lit("overexposed: mean "), fixed(mean, 1))).otherwise("exposure is in range"),
    )


def dimensions(c: Config) -> Column:
    width, height = F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))
    passed = (width >= c.min_width) & (height >= c.min_height)
    return verdict(
        S.DIMENSIONS, passed, F.lit("high"),
        details(width=width, height=height, minRequired=F.lit(f"{c.min_width}x{c.min_height}")),
        F.when(passed, "large enough").otherwise(f"smaller than {c.min_width}x{c.min_height}"),
    )


def screen_sized(width: Column, height: Column) -> Column:
    """Whether the sides, in either order, are those of a common screen; each pair is listed once, so no row fans out."""
    pair = F.least(width, height) * 100000 + F.greatest(width, height)
    return F.coalesce(pair.isin([a * 100000 + b for a, b in S.SCREENS]), F.lit(False))


def _present(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def screenshot(c: Config) -> Column:
    camera = _present(F.col("exif.make")) | _present(F.col("exif.model")) | _present(F.col("exif.captured_at"))
    screen, png = screen_sized(F.col("width"), F.col("height")), F.coalesce(F.col("format") == "png", F.lit(False))
    likely, edited = screen & ~camera, F.coalesce(F.col("exif.software").rlike(SUSPICIOUS_SOFTWARE), F.lit(False))
    signals = screen.cast("int") + (png & ~camera).cast("int") + (~camera).cast("int")
    return verdict(
        S.SCREENSHOT, ~(likely | edited), F.when(likely, "high").otherwise("medium"),
        details(
            width=F.coalesce("width", F.lit(0)), height=F.coalesce("height", F.lit(0)), format=F.coalesce("format", F.lit("unknown")), hasCameraExif=camera,
            matchesKnownScreenResolution=screen, exifSoftwareTag=F.col("exif.software"), screenshotSignalCount=signals,
        ),
        F.when(likely, "has the size of a screen and no camera data").when(edited, "saved by editing or capture software").otherwise("no sign of a screenshot"),
    )


def metadata(c: Config) -> Column:
    tags = F.coalesce("exif.tag_count", F.lit(0))
    passed = ~((F.coalesce(F.col("format"), F.lit("")) == "jpeg") & (tags == 0))
    return verdict(
        S.METADATA, passed, F.lit("low"),
        details(
            format=F.coalesce("format", F.lit("unknown")), hasExif=tags > 0, hasGps=F.col("exif.gps_latitude").isNotNull(),
            cameraMake=F.col("exif.make"), cameraModel=F.col("exif.model"), capturedAt=F.col("exif.captured_at"),
        ),
        F.when(passed, "camera data as expected for the format").otherwise("a photograph without any camera data"),
    )


def tampering(c: Config) -> Column:
    """Spike ratio of the recompression error. In the observed profile no recompression takes place, so all errors are 0."""
    skipped = F.coalesce(F.col("format") != "jpeg", F.lit(True))
    zero = F.lit(0.0)
    mean = F.when(F.col("ela_n") > 0, F.col("ela_sum") / F.col("ela_n")).otherwise(zero) if c.profile == DOCUMENTED else zero
    most = F.coalesce(F.col("ela_max"), F.lit(0)) if c.profile == DOCUMENTED else F.lit(0)
    ratio = F.when(mean > 0, most / mean).otherwise(zero)
    passed = skipped | (ratio <= c.ela_ratio)
    measured = details(meanErrorLevel=half_up(mean, 3), maxErrorLevel=most, spikeRatio=half_up(ratio, 2), threshold=F.lit(c.ela_ratio), recompressQuality=F.lit(c.ela_quality))
    reason = F.concat(F.lit("not applicable to "), F.coalesce("format", F.lit("unknown")))
    return verdict(
        S.TAMPERING, passed, F.lit("medium"),
        F.when(skipped, details(skipped=F.lit(True), reason=reason)).otherwise(measured),
        F.when(skipped, reason).when(passed, "compression error is even").otherwise(F.concat(F.lit("compression error has spikes: ratio "), fixed(ratio, 1))),
    )


def duplicate(c: Config) -> Column:
    kind = F.coalesce("match_type", F.lit("none"))
    exact, near = kind == "exact", kind == "near_duplicate"
    found = F.when(exact, details(matchType=kind, matchedImageId=F.col("matched_id"), matchedUploadedAt=F.col("matched_at")))
    found = found.when(near, details(matchType=kind, matchedImageId=F.col("matched_id"), hammingDistance=F.col("distance"), threshold=F.lit(c.near_distance)))
    return verdict(
        S.DUPLICATE, ~(exact | near), F.when(exact, "high").otherwise("medium"), found.otherwise(details(matchType=kind)),
        F.when(exact, F.concat(F.lit("same bytes as "), F.col("matched_id"))).when(near, F.concat(F.lit("looks like "), F.col("matched_id"))).otherwise("no copy found"),
    )


@dataclass(frozen=True)
class CheckSpec:
    """``error`` names the feature whose text, if any, keeps the check from running."""

    name: str
    build: Callable[[Config], Column]
    error: str | None = None
    needs: tuple[str, ...] = ()


REGISTRY: tuple[CheckSpec, ...] = (
    CheckSpec(S.BLUR, blur, "pixel_error", ("laplacian_var", "resized_to")),
    CheckSpec(S.BRIGHTNESS, brightness, "pixel_error", ("mean_red", "mean_luma")),
    CheckSpec(S.DIMENSIONS, dimensions, "header_error", ("width", "height")),
    CheckSpec(S.DUPLICATE, duplicate, None, ("match_type", "matched_id", "matched_at", "distance")),
    CheckSpec(S.SCREENSHOT, screenshot, "header_error", ("width", "height", "format", "exif")),
    CheckSpec(S.METADATA, metadata, "header_error", ("format", "exif")),
    CheckSpec(S.TAMPERING, tampering, "header_error", ("format", "ela_sum", "ela_n", "ela_max")),
    CheckSpec(S.PLATE, plates.check, None, ("ocr_text", "ocr_error", "known_plate")),
)


def column_of(spec: CheckSpec, c: Config) -> Column:
    result = spec.build(c)
    return isolated(spec.name, F.col(spec.error), result) if spec.error else result
