"""Uploads: a directory of files with a manifest, split into accepted and refused rows, and their features.

The files are Spark's binary source. Size and declared type are tested on the listing, before any content is read, and only accepted files are
read: once for hash and header, once by the JVM's decoder for pixels. Content goes through vectorised functions and is dropped there; the session's bound on
the bytes of a batch (64 MB by default) keeps batches of files small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom import schema as S
from frameloom.config import DOCUMENTED, Config
from frameloom.functions.columns import average_hash_bits, fingerprint_hex, packed_half
from frameloom.sources.exif import EMPTY, read_exif
from frameloom.sources.header import Unreadable, read_header
from frameloom.sources.pixels import measures


def refusal(mime: Column, size: Column, config: Config) -> Column:
    """Why an upload is refused, or null. The declared type decides; the limit itself is allowed."""
    return (
        F.when(mime.isNull() | ~mime.isin(list(S.MIME_EXTENSION)), "unsupported type")
        .when(size.isNull() | (size > config.max_upload_bytes), "too large")
    )


def stored_name(token: Column, mime: Column) -> Column:
    """A name that can't collide: a random id, made once and persisted, with the declared type's extension."""
    extension = F.create_map(*[F.lit(x) for pair in S.MIME_EXTENSION.items() for x in pair])
    return F.concat(token, extension[mime])


def registered(spark: SparkSession, uploads: DataFrame, path: str, folder: str) -> DataFrame:
    """New uploads (original_name, mime_type, size_bytes, uploaded_at) with an id and a stored name, both random.

    They are made once and written to ``path``, from which they are read ever after: a plan that is run again would make others.
    """
    made = uploads.withColumns({"id": F.expr("uuid()"), "stored_filename": stored_name(F.expr("uuid()"), F.col("mime_type"))})
    columns = [f.name for f in S.MANIFEST.fields]
    made.withColumn("storage_path", F.concat(F.lit(f"{folder}/"), "stored_filename")).select(columns).write.mode("errorifexists").parquet(path)
    return spark.read.schema(S.MANIFEST).parquet(path)


def split_manifest(manifest: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with ``reason``)."""
    judged = manifest.withColumn("reason", refusal(F.col("mime_type"), F.col("size_bytes"), config))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def read_files(spark: SparkSession, directory: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)


def read_images(spark: SparkSession, directory: str | list[str]) -> DataFrame:
    """Decoded JPEG and PNG pixels; the JVM's decoder gives sizes of -1 for files it can't read, WebP among them."""
    return spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(directory).select("image.*")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def header_row(content: bytes | None) -> dict:
    try:
        width, height, kind = read_header(content)
    except Unreadable as e:
        return {"width": None, "height": None, "format": None, "exif": dict(EMPTY), "header_error": str(e)}
    return {"width": width, "height": height, "format": kind, "exif": read_exif(content), "header_error": None}


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def header_udf():
    """Size, format and camera data of file contents; never raises."""

    @F.pandas_udf(S.HEADER)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            yield _frame([header_row(c) for c in contents], S.HEADER.names)

    return run


def pixel_row(data: bytes | None, height: int, width: int, channels: int, config: Config) -> dict:
    if not data or height <= 0 or width <= 0 or channels not in (1, 3, 4):
        return {"pixel_error": "the pixels could not be decoded"}
    try:
        stored = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        rgb = np.repeat(stored, 3, axis=2) if channels == 1 else stored[..., 2::-1]  # stored as blue, green, red
        return measures(rgb, config.blur_box, config.ela_quality, config.profile == DOCUMENTED)
    except Exception as e:  # noqa: BLE001 - one damaged file must not end the job
        return {"pixel_error": f"{type(e).__name__}: {e}"[:500]}


def pixel_udf(config: Config):
    """All pixel features in one pass over decoded images; never raises."""

    @F.pandas_udf(S.PIXELS)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for data, height, width, channels in batches:
            yield _frame([pixel_row(*x, config) for x in zip(data, height, width, channels)], S.PIXELS.names)

    return run


def with_fingerprint(rows: DataFrame) -> DataFrame:
    """Adds ahash_hi, ahash_lo and perceptual_hash from ``thumb8x8``; null where there is none."""
    bits = average_hash_bits(F.col("thumb8x8"))
    known = F.col("thumb8x8").isNotNull()
    halves = rows.withColumns({"ahash_hi": F.when(known, packed_half(bits, 1)), "ahash_lo": F.when(known, packed_half(bits, 33))})
    return halves.withColumn("perceptual_hash", fingerprint_hex(F.col("ahash_hi"), F.col("ahash_lo")))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def extract(spark: SparkSession, files: str | list[str], config: Config) -> DataFrame:
    """One narrow row per file of a directory or of a list of paths: path, name, hash, header and pixel features. File contents and pixels end here."""
    held = read_files(spark, files).where(F.col("length") <= config.max_upload_bytes)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    heads = held.select(plain(F.col("path")).alias("path"), content_hash(F.col("content")).alias("sha256_hash"), header_udf()("content").alias("h"))
    # The decoder gives its paths as URIs, in which a plus sign is one.
    origin = F.url_decode(F.replace(F.col("origin"), F.lit("+"), F.lit("%2B")))
    pixels = read_images(spark, files).select(plain(origin).alias("path"), pixel_udf(config)("data", "height", "width", "nChannels").alias("p"))
    made = heads.join(pixels, "path", "left").select("path", file_name(F.col("path")).alias("stored_filename"), "sha256_hash", "h.*", "p.*")
    return with_fingerprint(made)


def ingest(spark: SparkSession, manifest: DataFrame, directory: str | list[str], config: Config) -> tuple[DataFrame, DataFrame]:
    """(accepted pending rows with features, refused rows with ``reason``).

    ``manifest`` has the columns of ``schema.MANIFEST``; files are found by ``stored_filename``, of several with one name the one whose path
    comes first. Repeated ids count once. A row without a file, or with one that is too large, is refused. The paths of accepted files
    come to the driver, which has listed them anyway.
    """
    accepted, refused = split_manifest(manifest.dropDuplicates(["id"]), config)
    listing = read_files(spark, directory).select("path", "length", file_name(F.col("path")).alias("stored_filename"))
    wanted = listing.where(F.col("length") <= config.max_upload_bytes).join(accepted.select("stored_filename").distinct(), "stored_filename", "left_semi")
    paths = [r.path for r in wanted.groupBy("stored_filename").agg(F.min("path").alias("path")).collect()]
    listed = listing.groupBy("stored_filename").agg(F.min("length").alias("_least"))
    if paths:
        joined = accepted.join(extract(spark, [_literal(p) for p in paths], config).drop("path"), "stored_filename", "left")
        pending = joined.where("sha256_hash is not null").select(*manifest.columns, *[c for c in joined.columns if c not in manifest.columns])
        absent = joined.where("sha256_hash is null").select(*manifest.columns)
    else:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in (*S.HEADER.fields, *S.PIXELS.fields)]
        pending = with_fingerprint(accepted.select("*", F.lit(None).cast("string").alias("sha256_hash"), *none)).limit(0)
        absent = accepted.select(*manifest.columns)
    reason = F.when(F.col("_least") > config.max_upload_bytes, "too large").otherwise("file is missing")
    absent = absent.join(listed, "stored_filename", "left").select(*manifest.columns, reason.alias("reason"))
    pending = pending.withColumns({"status": F.lit(S.PENDING), "attempts": F.lit(0), "failure_reason": F.lit(None).cast("string")})
    return pending, refused.unionByName(absent)


def _literal(path: str) -> str:
    """A listed path as the reader takes it: pattern characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
